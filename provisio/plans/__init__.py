"""The registered queries over the test tables, and the same queries as SQL."""

from provisio.plans import answers, corpus, fetched, ingest, search

QUERIES: dict = {**search.QUERIES, **corpus.QUERIES, **ingest.QUERIES, **answers.QUERIES, **fetched.QUERIES}
SQL: dict = {**search.SQL, **corpus.SQL, **ingest.SQL, **answers.SQL, **fetched.SQL}
