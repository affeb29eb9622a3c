"""Requests answered by an injected caller, and drafts and responses read from what came."""

import json

import pytest
from provisio.operators import responses
from provisio.sources import fetching, metadata


def reply(*replies):
    """A caller that gives these, one after the other; exceptions are raised."""
    left = list(replies)

    def fetch(method, url):
        told = left.pop(0)
        if isinstance(told, Exception):
            raise told
        return told

    return fetch


@pytest.mark.parametrize(
    ("replies", "attempts", "told"),
    [
        ([fetching.Reply(200, "")], 1, (200, "", None)),
        ([fetching.Reply(503)], 1, (503, None, "HTTP_ERROR")),
        ([fetching.Reply(503), fetching.Reply(200, "x")], 2, (200, "x", None)),
        ([fetching.Reply(404), fetching.Reply(200, "x")], 3, (404, None, "HTTP_ERROR")),
        ([TimeoutError(), TimeoutError()], 2, (None, None, "TIMEOUT")),
        ([ConnectionResetError(), fetching.Reply(429), fetching.Reply(200, "y")], 3, (200, "y", None)),
        ([OSError()], 1, (None, None, "HTTP_ERROR")),
    ],
)
def test_one_request(replies, attempts, told):
    assert fetching.called(reply(*replies), "GET", "u", attempts, wait=lambda s: None) == told
    assert fetching.called(reply(), "GET", None) == (None, None, "CONFIG")


def test_replies_keep_what_was_asked(spark):
    def fetch(method, url):
        if url == "late":
            raise TimeoutError
        return fetching.Reply(200, {"empty": "", "odd": "[]", "list": '{"a": 1}', "none": "{}", "some": '{"Sprostowanie": [{"act": {"publisher": "DU", "year": 1, "pos": 2}}]}'}[url])

    wanted = spark.createDataFrame([(i, u) for i, u in enumerate(["late", "empty", "odd", "list", "none", "some", None])], "legal_act_id int, url string")
    told = {r.asked.url: (r.error, r.json) for r in fetching.act_references(fetching.fetched(wanted, fetch, callers=3)).collect()}
    assert told.pop("late") == ("TIMEOUT", None) and told.pop(None) == ("CONFIG", None)
    assert {u for u, (e, _) in told.items() if e == "INVALID_RESPONSE"} == {"empty", "odd", "list"}
    assert told["none"] == (None, "{}") and told["some"][0] is None
    assert fetching.fetched(wanted.limit(0), fetch).count() == 0
    with pytest.raises(ValueError, match="error"):
        fetching.fetched(wanted.withColumnRenamed("legal_act_id", "error"), fetch)


def test_metadata_of_another_shape_is_refused(spark):
    good = {"title": "t", "publisher": "DU", "year": 2000, "pos": 1, "ELI": "DU/2000/1", "status": "in force", "validFrom": "2001-02-03", "texts": [{"fileName": "a.pdf", "type": "O"}], "textHTML": True, "extra": 1}
    bodies = [good, {**good, "year": "x"}, {**good, "promulgation": "1.2.2000"}, [good], {k: v for k, v in good.items() if k != "title"}, {**good, "year": -1}]
    wanted = spark.createDataFrame([(i, str(i), "mine") for i in range(len(bodies))], "id int, url string, title string")
    rows = fetching.act_metadata(fetching.fetched(wanted, lambda m, u: fetching.Reply(200, json.dumps(bodies[int(u)]))))
    told = {r.asked.id: (r.error, r.title, r.status, r.asked.title) for r in rows.collect()}
    assert told[0] == (None, "t", "in force", "mine")
    assert all(told[i] == ("INVALID_RESPONSE", None, None, "mine") for i in range(1, len(bodies)))
    # drafts of what is reachable: nothing is current, and the act's own files belong to no expression
    there = spark.createDataFrame([("DU/2000/1/tj",), ("DU/2000/1/uj",), ("DU/9/9/tj",)], "uri string")
    fine = rows.where("error is null")
    drafts = {r.expression: r for r in metadata.version_drafts(fine, there).collect()}
    assert set(drafts) == {"tj", "uj"} and not any(r.is_current for r in drafts.values())
    assert (drafts["uj"].is_non_authoritative, drafts["tj"].is_non_authoritative, str(drafts["tj"].effective_from), drafts["tj"].source_document_key) == (True, False, "2001-02-03", "expression:tj")
    files = {(r.expression, r.file_name, r.representation_type) for r in metadata.resource_drafts(fine, there).collect()}
    assert files == {("tj", "tj.eli", "eli_expression"), ("uj", "uj.eli", "eli_expression"), (None, "a.pdf", "pdf"), (None, "text.html", "html")}


def test_probes(spark):
    def fetch(method, url):
        if url == "gone":
            raise ConnectionRefusedError
        return fetching.Reply({"a": 200, "b": 405 if method == "HEAD" else 200, "c": 501 if method == "HEAD" else 404, "d": 404, "e": 503}[url])

    rows = fetching.probed(spark.createDataFrame([(u,) for u in ("a", "b", "c", "d", "e", "gone")], "uri string"), fetch).collect()
    assert {r.uri: (r.is_available, r.error) for r in rows} == {"a": (True, None), "b": (True, None), "c": (False, None), "d": (False, None), "e": (False, None), "gone": (None, "HTTP_ERROR")}


ISSUE = {"label": "l", "likelihood": "possible", "rationale": "r", "answerTargetIndexes": [1], "retrievalQueries": [{"query": "q", "answerTargetIndex": 1}]}
WHOLE = {"summary": "s", "answerTargets": [{"text": "t"}], "issues": [ISSUE]}


@pytest.mark.parametrize(
    ("told", "fine"),
    [
        (WHOLE, True),
        ({**WHOLE, "clarificationQuestion": ""}, True),
        ({"summary": "s", "answerTargets": [], "issues": []}, True),
        ({**WHOLE, "issues": [{**ISSUE, "answerTargetIndexes": [2]}]}, False),
        ({**WHOLE, "issues": [{**ISSUE, "answerTargetIndexes": []}]}, False),
        ({**WHOLE, "issues": [{**ISSUE, "answerTargetIndexes": [0]}]}, False),
        ({**WHOLE, "issues": [{**ISSUE, "retrievalQueries": []}]}, False),
        ({**WHOLE, "issues": [{**ISSUE, "retrievalQueries": [{"query": "", "answerTargetIndex": 1}]}]}, False),
        ({**WHOLE, "issues": [ISSUE, {**ISSUE, "rationale": None}]}, False),
        ({**WHOLE, "answerTargets": [{"text": "t"}] * 5}, False),
        ({**WHOLE, "answerTargets": []}, False),
        ({"summary": "s", "issues": []}, False),
        ({**WHOLE, "note": 1}, False),
        ({**WHOLE, "issues": None}, False),
        ([], False),
    ],
)
def test_detections(spark, told, fine):
    row = responses.detected(spark.createDataFrame([(1, json.dumps(told))], "request int, json string")).first()
    assert row.is_valid == fine and (row.summary == "s") == fine and row.clarification is None


def test_recoveries_and_envelopes(spark):
    one = {"statement": "s", "support": [{"sourceId": "A", "excerpt": "e"}], "answerTargetIndex": None}
    cases = [
        ({"conclusions": [one], "uncertainties": []}, True), ({"conclusions": [], "uncertainties": ["u"]}, True), ({"conclusions": [{**one, "answerTargetIndex": 2}], "uncertainties": []}, True),
        ({"conclusions": [{**one, "answerTargetIndex": 1}], "uncertainties": []}, False), ({"conclusions": [{**one, "support": []}], "uncertainties": []}, False), ({"conclusions": [one]}, False),
        ({"conclusions": [{**one, "support": [{"sourceId": "B", "excerpt": "e"}]}], "uncertainties": []}, False), ({"conclusions": [], "uncertainties": [""]}, False), ({"conclusions": [{**one, "support": [{"sourceId": "A"}]}], "uncertainties": []}, False),
    ]
    sent = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(99, None)], "request int, json string")
    offered = sent.selectExpr("request", "array('A') as sources", "array(2L) as targets")
    told = {r.request: r.is_valid for r in responses.recoveries(sent, offered).collect()}
    assert told == {i: fine for i, (_, fine) in enumerate(cases)} | {99: False}
    choice = lambda **x: {"choices": [{"message": {"content": "{}", **x}, "finish_reason": "stop"}]}
    envelopes = [choice(), choice(refusal="no"), choice(content=None), {"choices": []}, {"choices": [{"message": {"content": "{}"}, "finish_reason": "length"}]}, {"choices": [{"message": {"content": "{}"}}]}, "x"]
    rows = responses.completed(spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(envelopes)], "request int, json string")).collect()
    assert {r.request for r in rows if r.error is None and r.json == "{}"} == {0, 5}
    assert all(r.error == "INVALID_RESPONSE" and r.json is None for r in rows if r.request not in (0, 5))
