"""What both text sources make: rows of a provision tree in reading order."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

SCHEMA = (
    "id string, parent_id string, provision_type string, article string, paragraph string, point string, letter string, "
    "citation_label string, heading string, text string, structural_path string, ordinal int"
)
FIELDS = tuple(part.split()[0] for part in SCHEMA.split(", "))

# The mark of a level in headings and in labels, and the column of its number.
MARKS = {
    "article": ("Art. {}.", "art. {}", "article"),
    "paragraph": ("§ {}.", "{} § {}", "paragraph"),
    "clause": ("{}.", "{} ust. {}", "paragraph"),
    "point": ("{})", "{} pkt {}", "point"),
    "letter": ("{})", "{} lit. {}", "letter"),
}


@dataclass
class Unit:
    kind: str
    heading: str
    label: str
    path: str
    ordinal: int
    parent: Unit | None = None
    number: str | None = None
    body: list[str] = field(default_factory=list)


class Outline:
    """Units in order; a path that was used before gets #ordinal."""

    def __init__(self):
        self.units: list[Unit] = []
        self.paths: set[str] = set()
        self.taken = 0

    def add(self, kind: str, heading: str, label: str, path: str, parent: Unit | None = None, number: str | None = None) -> Unit:
        ordinal = self.taken + len(self.units) + 1
        if path in self.paths:
            path = f"{path}#{ordinal}"
        self.paths.add(path)
        self.units.append(Unit(kind, heading, label, path, ordinal, parent, number))
        return self.units[-1]

    def add_numbered(self, kind: str, number: str, path: str, parent: Unit | None) -> Unit:
        """A unit whose heading and label follow from its number; labels go on from the parent's, but restart at an article."""
        heading, label, _ = MARKS[kind]
        label = label.format(number) if kind == "article" else label.format(parent.label if parent else "", number)
        return self.add(kind, heading.format(number), label, path, parent, number)

    def rows(self, document: str) -> list[dict]:
        """Ids depend on document and path only, so a task that runs again makes the same rows."""
        name = lambda u: hashlib.sha256(f"{document}\x1f{u.path}".encode()).hexdigest() if u else None
        out = []
        for u in self.units:
            row = dict.fromkeys(FIELDS)
            row |= {"id": name(u), "parent_id": name(u.parent), "provision_type": u.kind, "citation_label": u.label, "heading": u.heading, "structural_path": u.path, "ordinal": u.ordinal}
            row["text"] = " ".join(x for x in (u.heading, *u.body) if x).strip()
            if u.kind in MARKS:
                row[MARKS[u.kind][2]] = u.number
            out.append(row)
        return out

    def take(self, document: str) -> list[dict]:
        """``rows`` of the units so far, which are let go; those that follow are numbered on."""
        out = self.rows(document)
        self.taken += len(self.units)
        self.units = []
        return out


class SourceError(ValueError):
    """A text that must not be guessed at."""
