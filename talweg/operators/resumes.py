"""Structure out of Markdown: sections, entries (title, subtitle, period, bullets) and categories of skills.

A document's lines go once through a small machine in a table function, one document at a time and one line after the
other; of each section only the entry or category that is open is held. A heading of level one or two that holds a
section's keyword opens that section (a section may come again and goes on where it was); other headings open an entry
within it. A period stands in an entry's heading or alone on the next line.

Null and empty texts have no rows. What stands before the first section is section `intro`: its headings are entries
without bullets, its other lines bullets of one entry without a title. Texts of any length are read to the end; rows that
repeat give their parts again. Columns of the input are taken by name, so none clashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Beginnings of months, words for a period that goes on, and what stands between a title and its subtitle.
MONTHS = ("jan", "fév", "feb", "mar", "avr", "apr", "mai", "may", "juin", "jun", "juil", "jul", "aoû", "aug", "sep", "oct", "nov", "déc", "dec")
RUNNING = ("présent", "present", "aujourd'hui", "current", "maintenant", "en cours")
SEPARATORS = (r"\s+[-–|@]\s+", r"\s+chez\s+", r"\s+at\s+", r"\s+pour\s+")
SKILLS = "skills"
PARTS = "section string, part int, kind string, title string, subtitle string, period string, items array<string>"

_LAST = rf"(?:\d{{4}}|{'|'.join(RUNNING)})"
_MONTH = rf"(?:{'|'.join(MONTHS)})\.?\s+"
_ALONE = re.compile(rf"(?:{_MONTH}\d{{4}}\s*[-–]\s*(?:{_MONTH})?{_LAST}|\d{{4}}\s*[-–]\s*{_LAST})", re.IGNORECASE)
_WITHIN = re.compile(rf"\((?P<round>[^)]*\d{{4}}[^)]*)\)|(?P<bare>\d{{4}}\s*[-–]\s*{_LAST})", re.IGNORECASE)
_BETWEEN = re.compile("|".join(SEPARATORS), re.IGNORECASE)
_HEADING = re.compile(r"(#{1,3})\s+(.+)")
_BOLD = re.compile(r"\*\*(.+?)\*\*")
_BOLD_CATEGORY = re.compile(r"\*\*([^*]{1,40})\*\*\s*:?\s*(.*)")
_NAMED_ITEMS = re.compile(r"([A-ZÀ-Üa-zà-ü][^:]{1,35})\s*:\s*(.{3,})")


class _Part:
    """An entry or category that is open."""

    def __init__(self, number: int, kind: str, title: str = "", subtitle: str = "", period: str = ""):
        self.number, self.kind, self.title, self.subtitle, self.period, self.items, self.fresh = number, kind, title, subtitle, period, [], not period

    def row(self, section: str) -> tuple:
        return section, self.number, self.kind, self.title, self.subtitle, self.period, self.items


def entry_of(heading: str, number: int) -> _Part:
    """The entry that a heading opens."""
    heading = re.sub(r"&\w+;", " ", heading).strip()
    period = ""
    if found := _WITHIN.search(heading):
        period = (found["round"] or found["bare"] or "").strip()
        heading = (heading[: found.start()].rstrip("( ") + heading[found.end() :].lstrip(") ")).strip()
    title, *rest = _BETWEEN.split(heading, maxsplit=1)
    return _Part(number, "entry", title.strip(), rest[0].strip() if rest else "", period)


def _items(text: str, signs: str = ",;|/") -> list[str]:
    return [x.strip() for x in re.split(f"[{signs}]", text) if x.strip()]


class _Sections:
    """The machine: takes lines, gives parts that are closed."""

    def __init__(self, keywords: dict[str, list[str]]):
        self.keywords, self.section, self.open, self.made = keywords, "intro", {}, {}

    def named(self, heading: str) -> str | None:
        low = re.sub(r"&\w+;", " ", heading.lower())
        return next((s for s, words in self.keywords.items() if any(w in low for w in words)), None)

    def begin(self, part: _Part) -> Iterator[tuple]:
        before = self.open.get(self.section)
        if before and (before.kind == "entry" or before.items):
            yield before.row(self.section)
        self.open[self.section] = part

    def number(self) -> int:
        self.made[self.section] = self.made.get(self.section, 0) + 1
        return self.made[self.section] - 1

    def line(self, line: str) -> Iterator[tuple]:
        heading, bare = _HEADING.match(line), line.strip()
        if heading and len(heading[1]) <= 2 and (section := self.named(heading[2])):
            self.section = section
        elif not bare or bare == "<!-- image -->":
            return
        elif self.section == SKILLS:
            yield from self.skill(heading, bare)
        elif heading or (self.section != "intro" and _BOLD.match(line) and re.search(r"\d{4}", line)):
            yield from self.begin(entry_of(heading[2] if heading else bare.replace("*", ""), self.number()))
        else:
            part = self.open.get(self.section)
            if part is None and self.section == "intro":
                yield from self.begin(part := _Part(self.number(), "entry"))
            if part and part.fresh and part.title and _ALONE.fullmatch(bare):
                part.period, part.fresh = bare, False
            elif part:
                part.fresh = False
                if item := re.sub(r"^[-•*]\s+", "", bare):
                    part.items.append(item)

    def skill(self, heading: re.Match | None, bare: str) -> Iterator[tuple]:
        if heading:
            yield from self.begin(_Part(self.number(), "category", heading[2].strip()))
        elif bold := _BOLD_CATEGORY.fullmatch(bare):
            yield from self.begin(_Part(self.number(), "category", bold[1].strip()))
            self.open[self.section].items += _items(bold[2], ",;|")
        elif (named := _NAMED_ITEMS.fullmatch(bare)) and (items := _items(named[2])):
            yield from self.begin(_Part(self.number(), "category", named[1].strip()))
            self.open[self.section].items += items
            yield from self.begin(_Part(-1, "category"))
        elif not named:
            part = self.open.get(self.section)
            if part is None or part.number < 0:
                self.open[self.section] = part = _Part(self.number(), "category", "Compétences")
            part.items += _items(re.sub(r"^[-•*]\s+", "", bare))

    def end(self) -> Iterator[tuple]:
        for section, part in self.open.items():
            if part.kind == "entry" or part.items:
                yield part.row(section)


def parts(docs: DataFrame, key: str, text: str, keywords: dict[str, list[str]]) -> DataFrame:
    """key, section, part (its number in the section), kind (entry, category), title, subtitle, period, items, for `docs` of Markdown.

    `keywords` has each section's, in the order in which they are looked for; the section `skills` has categories.
    """

    class Machine:
        def eval(self, text: str) -> Iterator[tuple]:
            machine = _Sections(keywords)
            for line in re.finditer(r"[^\n]+", text or ""):
                yield from machine.line(line[0])
            yield from machine.end()

    machine = udtf(Machine, returnType=PARTS)
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return own.lateralJoin(machine(F.col("text").outer())).select(F.col("key").alias(key), "section", "part", "kind", "title", "subtitle", "period", "items")
