"""Personal data in texts: what kinds of it stand where, and masking.

A text is read once into number groups and capitalised words; each kind then names the stretches of these that have its
layout and pass its check. Kinds take turns (account, social security, VAT, company, card, e-mail, profile, phone, date,
address, plate, amount, identity), and a stretch that touches one already taken is dropped. At last the words of
identities and of e-mail names (four letters or more) are looked for everywhere else, whatever their case and accents.
Spans are in code points, end exclusive. Values are never logged; results hold kinds and offsets. Null and empty texts
have no span; every text is read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterable, Iterator
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from talweg.operators.blocks import bounded_batches

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"

# Fixed values -----------------------------------------------------------------------------------------------------
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
PROFILES = ("linkedin.com/in", "github.com", "gitlab.com", "twitter.com", "x.com")
WAYS = (
    "rue", "avenue", "av", "boulevard", "bd", "chemin", "allée", "impasse", "place", "route", "quai", "cours", "square", "villa", "passage",
    "hameau", "lotissement", "faubourg", "résidence", "rond-point", "esplanade", "promenade", "sentier", "traverse", "venelle", "cité", "clos",
    "domaine", "parvis", "montée", "côte", "voie", "zone", "za", "zi", "zac", "lieu-dit",
)
TITLES = ("M.", "Mr", "Mr.", "Mme", "Mlle", "Melle", "Monsieur", "Madame", "Mademoiselle", "Dr", "Docteur", "Me", "Maître", "Maitre", "Pr", "Professeur")
LABELS = ("nom", "nom de famille", "prénom", "prénoms", "candidat", "consultant", "salarié", "employé", "intervenant", "référent", "sous-traitant", "représenté par", "signé par", "contact")
PARTICLES = ("de la", "de", "del", "van", "von", "ben", "el", "al", "di", "da", "le", "la", "dos", "du")
NOT_NAMES = frozenset(
    "apache google microsoft amazon oracle adobe gitlab github linkedin power data cloud open web big air france paris groupe societe university "
    "universite institut lycee faculte ecole master licence bachelor direction service agence cabinet departement region projet mission client "
    "formation experience experiences competence competences langues contact profil profils diplome diplomes projets education technologies "
    "technologie certifications certification curriculum vitae resume laureat laureate ingenieur ingenieure docteur titulaire analytics engineer "
    "analyst developer consultant manager senior junior stage stagiaire alternance freelance sorbonne pantheon".split()
)
# ------------------------------------------------------------------------------------------------------------------

MARKED, BARE = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿœæ", "aaaaaaceeeeiiiinooooouuuuyyoa"
_PLAIN = str.maketrans(MARKED, BARE)


def plain(text: str) -> str:
    """Lower case without accents, a character for each character, so that positions stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_PLAIN)


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits]
    return sum(values[-1::-2], sum(sum(divmod(2 * v, 10)) for v in values[-2::-2])) % 10 == 0


def iban_ok(value: str) -> bool:
    c = value.replace(" ", "").upper()
    return 15 <= len(c) <= 34 and c.isascii() and c.isalnum() and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def social_ok(value: str) -> bool:
    """15 characters: sex, year, month (or what stands for an unknown one), department, commune, order, key."""
    c = re.sub("[ .]", "", value).upper()
    number = c[:13].replace("2A", "19", 1).replace("2B", "18", 1)
    if len(c) != 15 or not (number + c[13:]).isdigit() or c[0] not in "12":
        return False
    return (1 <= int(c[3:5]) <= 12 or int(c[3:5]) >= 20) and int(number) % 97 + int(c[13:]) == 97


def vat_ok(value: str) -> bool:
    c = value.replace(" ", "").upper()
    return c[:2] == "FR" and len(c) == 13 and c[2:].isdigit() and luhn(c[4:]) and (3 * int(c[4:]) + 12) % 97 == int(c[2:4])


def postcode_ok(code: str) -> bool:
    return 1 <= int(code[:2]) <= 98 and code[:2] != "96"


class Reading(NamedTuple):
    """A text, its runs of number groups (start, end), and its capitalised words (end by start, start by end)."""

    text: str
    runs: list[list[tuple[int, int]]]
    words: dict[int, int]
    ends: dict[int, int]

    def whole(self, a: int, b: int) -> bool:
        """Whether neither end cuts a word."""
        t = self.text
        return not (a and (t[a - 1].isalnum() or t[a - 1] == "_")) and not (b < len(t) and (t[b].isalnum() or t[b] == "_"))


_RUN = re.compile(r"[0-9](?:[ ./-]?[0-9]|(?<=2)[AB](?=[ .]?[0-9]))*")
_GROUP = re.compile("[0-9AB]+")
CAPITALISED = rf"(?<![{_UP}{_LOW}])[{_UP}][{_UP}{_LOW}'’-]+"
_WORD = re.compile(CAPITALISED)


def read(text: str) -> Reading:
    runs = [[g.span() for g in _GROUP.finditer(text, *m.span())] for m in _RUN.finditer(text)]
    words = dict(m.span() for m in _WORD.finditer(text))
    return Reading(text, runs, words, {b: a for a, b in words.items()})


def _numbers(r: Reading, sizes: range, cuts: Collection[int], joints: str) -> Iterator[tuple[int, int, str]]:
    """Groups in a row that hold one of `sizes` characters, parted by one of `joints` after some of `cuts` characters: the longest from the left, without overlaps."""
    for groups in r.runs:
        i = 0
        while i < len(groups):
            size, last = 0, -1
            for j in range(i, len(groups)):
                if j > i and (size not in cuts or r.text[groups[j][0] - 1] not in joints):
                    break
                size += groups[j][1] - groups[j][0]
                if size >= sizes.stop:
                    break
                if size in sizes:
                    last = j
            if last < 0:
                i += 1
                continue
            a, b = groups[i][0], groups[last][1]
            yield a, b, "".join(r.text[x:y] for x, y in groups[i : last + 1])
            i = last + 1


def _account(r: Reading) -> Iterator[tuple[int, int]]:
    """Two capitals, two digits, and blocks that single spaces part: the longest stretch whose key is right."""
    for m in re.finditer(r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}", r.text):
        stops, at, size = [], m.start(), 0
        while block := re.compile("[A-Z0-9]+").match(r.text, at):
            size += len(block[0])
            if size > 34:
                break
            stops.append(block.end())
            at = block.end() + 1
            if r.text[block.end() : at] != " ":
                break
        good = [b for b in reversed(stops) if r.whole(m.start(), b) and iban_ok(r.text[m.start() : b])]
        if good:
            yield m.start(), good[0]


def _social(r: Reading) -> Iterator[tuple[int, int]]:
    return ((a, b) for a, b, d in _numbers(r, range(15, 16), (1, 3, 5, 7, 10, 13), " .") if r.whole(a, b) and social_ok(d))


def _vat(r: Reading) -> Iterator[tuple[int, int]]:
    for a, b, d in _numbers(r, range(11, 12), (2, 5, 8), " "):
        start = a - 3 if r.text[a - 1 : a] == " " else a - 2
        if start >= 0 and r.text[start : start + 2] == "FR" and r.whole(start, b) and vat_ok("FR" + d):
            yield start, b


def _company(r: Reading) -> Iterator[tuple[int, int]]:
    for size, cuts in ((14, (3, 6, 9)), (9, (3, 6))):
        yield from ((a, b) for a, b, d in _numbers(r, range(size, size + 1), cuts, " .") if d.isdigit() and r.whole(a, b) and luhn(d))


def _card(r: Reading) -> Iterator[tuple[int, int]]:
    return ((a, b) for a, b, d in _numbers(r, range(13, 20), range(1, 20), " -") if d.isdigit() and r.whole(a, b) and luhn(d))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL, _DOT = re.compile("[A-Za-z0-9-]+"), re.compile(r" ?\. ?")


def _email(r: Reading) -> Iterator[tuple[int, int]]:
    """Outwards from the sign, or from what is written for it: up to 64 characters of a name, and labels of which the last begins with 2 to 24 letters. A space may stand at each sign and dot."""
    t = r.text
    for m in re.finditer(r"@|\(at\)|\[at\]", t, re.IGNORECASE):
        a = stop = m.start() - (t[m.start() - 1 : m.start()] == " ")
        while a > 0 and stop - a < 64 and t[a - 1] in _LOCAL:
            a -= 1
        end, at, first = -1, m.end() + (t[m.end() : m.end() + 1] == " "), True
        while label := _LABEL.match(t, at):
            letters = re.match("[A-Za-z]{0,24}", label[0]).end()
            if not first and letters >= 2:
                end = at + letters
            dot, first = _DOT.match(t, label.end()), False
            if not dot:
                break
            at = dot.end()
        if a < stop and end > 0:
            yield a, end


_PROFILE = re.compile(rf"(?:{'|'.join(map(re.escape, PROFILES))})/([A-Za-z0-9_.-]{{2,40}})", re.IGNORECASE)
#: Of each site what a text in lower case must hold.
_SITES = frozenset("." + p.split(".")[1].split("/")[0] for p in PROFILES)


def _profile(r: Reading) -> Iterator[tuple[int, int]]:
    low = r.text.lower()
    for m in _PROFILE.finditer(r.text) if any(x in low for x in _SITES) else ():
        a = m.start()
        for before in (("www.",), ("https://", "http://")):
            a -= next((len(x) for x in before if r.text[max(0, a - len(x)) : a].lower() == x), 0)
        yield a, m.end()


def _phone(r: Reading) -> Iterator[tuple[int, int]]:
    """After +33 nine digits, a 0 before them allowed; else ten digits from 0."""
    for m in re.finditer(r"\(?\+ ?33", r.text):
        at, digits = m.end(), ""
        want = 9
        while step := re.compile(r"[ .()-]{0,3}([0-9])").match(r.text, at):
            digits, at = digits + step[1], step.end()
            want = 10 if digits[0] == "0" else 9
            if len(digits) == want:
                break
        if len(digits) == want and digits.lstrip("0")[:1] and len(digits.lstrip("0")) == 9:
            yield m.start(), at
    yield from ((a, b) for a, b, d in _numbers(r, range(10, 11), range(2, 10), " .-") if d.isdigit() and d[0] == "0" < d[1] and r.whole(a, b))


def _date(r: Reading) -> Iterator[tuple[int, int]]:
    t = r.text
    for groups in r.runs:
        for (a, x), (b, y), (c, z) in zip(groups, groups[1:], groups[2:], strict=False):
            small = x - a < 3 and y - b < 3 and z - c == 4 and t[x] in "/.-" and t[y] in "/.-"
            if small and (t[a:x] + t[b:y]).isdigit() and int(t[a:x]) < 40 and int(t[b:y]) < 20 and t[c : c + 2] in ("19", "20") and r.whole(a, z):
                yield a, z
    for m in re.finditer(rf"([0-9]{{1,2}})(?:er)? +([{_UP}{_LOW}]+) +([0-9]{{4}})", t, re.IGNORECASE):
        if plain(m[2]) in MONTHS and int(m[1]) < 40 and m[3][:2] in ("19", "20") and r.whole(*m.span()):
            yield m.span()


_WAY = re.compile(rf"(?<![{_UP}{_LOW}])(?:{'|'.join(sorted((w.replace('-', '[- ]') for w in WAYS + tuple(plain(w) for w in WAYS)), key=len, reverse=True))})\.? +(?=[{_UP}{_LOW}0-9'’-])", re.IGNORECASE)
_TO_WAY = re.compile(r" ?(?:bis|ter|quater)?[ ,]{0,3}", re.IGNORECASE)
_PLACE = re.compile(rf"[{_UP}{_LOW}0-9'’ -]{{3,46}}")
_TOWN = re.compile(rf" ?(?:- ?)?([{_UP}][{_UP}{_LOW}'’ -]{{2,30}})")


def _address(r: Reading) -> Iterator[tuple[int, int]]:
    """A number, a kind of way and its name; a postcode and a town; a town of at most three words and a postcode."""
    t = r.text
    for a, b in ((a, b) for groups in r.runs for a, b in groups if b - a <= 4 and t[a:b].isdigit() and not (a and (t[a - 1].isalnum() or t[a - 1] == "_"))):
        way = _WAY.match(t, _TO_WAY.match(t, b).end())
        name = way and _PLACE.match(t, way.end())
        if name and not re.search(r"\bau *\Z", name[0], re.IGNORECASE):
            yield a, name.end()
    codes = [(a, b) for groups in r.runs for a, b in groups if b - a == 5 and t[a:b].isdigit() and postcode_ok(t[a:b]) and not t[a - 1 : a].isalnum()]
    for a, b in codes:
        if town := _TOWN.match(t, b):
            yield a, town.end()
    for a, b in codes:
        gap = len(t[max(0, a - 3) : a]) - len(t[max(0, a - 3) : a].rstrip(" ,"))
        start, count = a - gap, 0
        while count < 3 and start in r.ends and start - r.ends[start] >= 3 and t[r.ends[start] + 1 : start].upper() != t[r.ends[start] + 1 : start]:
            start, count = r.ends[start], count + 1
            if count < 3 and start - 1 in r.ends and t[start - 1] == " ":
                start -= 1
        start += t[start : start + 1] == " "
        if count and gap and t[a - 1] == " " and r.whole(start, b):
            yield start, b


_PLATE = frozenset("ABCDEFGHJKLMNPQRSTVWXYZ")


def _plate(r: Reading) -> Iterator[tuple[int, int]]:
    t = r.text
    for groups in r.runs:
        for a, b in groups:
            near = t[max(0, a - 3) : a] + t[b : b + 3]
            if b - a == 3 and len(near) == 6 and {near[2], near[3]} <= {"-", " "} and set(near[:2] + near[4:]) <= _PLATE and r.whole(a - 3, b + 3):
                yield a - 3, b + 3


def _amount(r: Reading) -> Iterator[tuple[int, int]]:
    """Back from the currency: two decimals after a comma, blocks of three digits, and one to three before them."""
    t = r.text
    for m in re.finditer(r"(?<=[0-9 ])(?:€|eur(?:os?)?)(?![A-Za-z])", t, re.IGNORECASE):
        at = m.start() - (t[m.start() - 1] == " ")
        if at >= 4 and t[at - 3] == "," and t[at - 2 : at].isdigit():
            at -= 3
        start = at
        while (n := len(block := re.search("[0-9]*\\Z", t[max(0, start - 4) : start])[0])) == 3 and start >= 5 and t[start - 4] in " ." and t[start - 5].isdigit():
            start -= 4
        if 1 <= n <= 3 and block and r.whole(start - n, m.end()):
            yield start - n, m.end()


def _person(r: Reading, at: int, more: int = 2) -> int | None:
    """Where a name that starts at `at` ends: a capitalised word, perhaps a particle, and up to `more` further ones."""
    if at not in r.words:
        return None
    end = r.words[at]
    for k in range(more):
        steps = (" ", *(f" {p} " for p in PARTICLES)) if k == 0 else (" ",)
        nxt = next((end + len(s) for s in steps if r.text.startswith(s, end) and end + len(s) in r.words), None)
        if nxt is None:
            break
        end = r.words[nxt]
    return end


def _named(text: str) -> bool:
    """Whether none of the words is one that isn't taken for a person."""
    return not any(plain(w) in NOT_NAMES for w in text.split())


_TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))}) +(?=[{_UP}])")
_LABELLED = re.compile(rf"(?<!\w)(?:{'|'.join(sorted((re.sub('[éèê]', '[ée]', x).replace(' par', 'e? par') for x in LABELS), key=len, reverse=True))})e? *:? +", re.IGNORECASE)

_TITLED = tuple(f"{x} " for x in TITLES)
#: The first word of each label in lower case, with and without each accent (shorter ones stand for those that hold them), and the signs that stand for an i or s of it, whatever their case.
_SPELT = {"".join(w) for x in LABELS for w in product(*(("é", "e") if c == "é" else c for c in x.split()[0]))}
_LABEL_WORDS = tuple(w for w in _SPELT if not any(x in w for x in _SPELT - {w}))
_LIKE_LETTERS = "ıİſ"


def _identity(r: Reading, first_names: Collection[str], header: bool) -> Iterator[tuple[int, int]]:
    """By place (two to four capitalised words alone on one of the first four lines, if `header`), title, label, case (a word in capitals of five letters beside a capitalised one) and first name."""
    t = r.text
    if not r.words:
        return
    if header:
        lines = [m for m in re.finditer(r"[^\n]*[^\s][^\n]*", t[:4000])][:4]
        for m in lines:
            line = m[0].strip()
            a = m.start() + m[0].index(line)
            if 5 <= len(line) <= 40 and " " in line and _person(r, a, 3) == a + len(line) and not any(p in line.split() for p in PARTICLES) and _named(line):
                yield a, a + len(line)
    for m in _TITLE.finditer(t) if any(x in t for x in _TITLED) else ():
        if end := _person(r, m.end()):
            yield m.end(), end
    low = t.lower()
    for m in _LABELLED.finditer(t) if any(x in low for x in _LABEL_WORDS) or any(x in t for x in _LIKE_LETTERS) else ():
        if (end := _person(r, m.end())) and _named(t[m.end() : end]):
            yield m.end(), end
    kind = {a: "loud" if t[a:b].isupper() and b - a >= 5 else "name" if t[a + 1 : b].islower() else "" for a, b in r.words.items()}
    for want in (["name", "loud"], ["loud", "name"]) if "loud" in kind.values() else ():
        for a, b in r.words.items():
            if t[b : b + 1] == " " and b + 1 in r.words and [kind[a], kind[b + 1]] == want and _named(t[a : r.words[b + 1]]):
                yield a, r.words[b + 1]
    for a, b in r.words.items() if first_names else ():
        if kind[a] == "name" and any(x in first_names for x in plain(t[a:b]).split("-")):
            end = _person(r, a)
            end = end if _named(t[b:end]) else b
            before = r.ends.get(a - 1) if t[a - 1 : a] == " " else None
            loud = before is not None and t[before : a - 1].isupper() and a - 1 - before >= 3 and _named(t[before : a - 1])
            yield before if loud else a, end


#: The kinds in the order in which they take their stretches; identities come after them.
KINDS = (
    ("iban", _account), ("nir", _social), ("tva", _vat), ("siret", _company), ("carte", _card), ("email", _email), ("lien", _profile),
    ("telephone", _phone), ("date", _date), ("adresse", _address), ("plaque", _plate), ("montant", _amount),
)
#: Those that a text without figures may have.
_FIGURELESS = tuple((k, f) for k, f in KINDS if k in ("email", "lien"))


class Taken:
    """Spans without overlaps, by start."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.spans: list[tuple[str, int, int]] = []

    def put(self, kind: str, a: int, b: int) -> None:
        k = bisect_right(self.starts, a)
        if (k and self.spans[k - 1][2] > a) or bisect_left(self.starts, b) > k:
            return
        self.starts.insert(k, a)
        self.spans.insert(k, (kind, a, b))


_LETTERS = re.compile("[a-z]+")
_NAME = re.compile("[a-z]+(?:['’-][a-z]+)*")
_RUNS = re.compile("[a-z0-9]+")
_SIGN = re.compile(r"@|\(at\)|\[at\]")


def known_words(text: str, spans: Iterable[tuple[str, int, int]]) -> set[str]:
    """The words (four letters or more) of these spans' identities and e-mail names, by which a person may be named elsewhere."""
    found: set[str] = set()
    for kind, a, b in spans:
        if kind == "identite":
            found.update(_NAME.findall(plain(text[a:b])))
        elif kind == "email":
            found.update(_LETTERS.findall(_SIGN.split(plain(text[a:b]), maxsplit=1)[0]))
    return {w for w in found if len(w) >= 4 and w not in NOT_NAMES}


def elsewhere(text: str, words: Collection[str]) -> Iterator[tuple[int, int]]:
    """Where these words stand by themselves, whatever their case and accents: from the left, the longest first."""
    if not words:
        return
    begins: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        begins.setdefault(_RUNS.match(w)[0], []).append(w)
    low, done = plain(text), 0
    for m in _RUNS.finditer(low):
        for w in begins.get(m[0], ()) if m.start() >= done else ():
            end = m.start() + len(w)
            if low.startswith(w, m.start()) and not _RUNS.match(low, end):
                yield m.start(), end
                done = end
                break


def shown(text: str, first_names: Collection[str], header: bool) -> Taken:
    """The spans that show by themselves."""
    reading, taken = read(text), Taken()
    for kind, stretches in KINDS if reading.runs else _FIGURELESS:
        for a, b in stretches(reading):
            taken.put(kind, a, b)
    for a, b in _identity(reading, first_names, header):
        taken.put("identite", a, b)
    return taken


def detect(text: str | None, first_names: Collection[str] = (), header: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start. `first_names`, in lower case without accents, are the caller's dictionary."""
    if not text:
        return []
    taken = shown(text, first_names, header)
    for a, b in elsewhere(text, known_words(text, taken.spans)):
        taken.put("identite", a, b)
    return taken.spans


def mask(text: str, spans: list[tuple[str, int, int]], by: str = "█") -> str:
    """`text` with the spans blotted out, character for character."""
    out, done = [], 0
    for _, a, b in spans:
        out += [text[done:a], by * (b - a)]
        done = b
    return "".join(out) + text[done:]


def detected(df: DataFrame, key: str, text: str, first_names: Collection[str] = (), header: bool = False) -> DataFrame:
    """key, spans, masked: a row per row of `df`."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = frozenset(first_names)
    bounded_batches(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [detect(t, names, header) for t in texts]
            told = [[{"type": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, kind), pa.array([t and mask(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())], names=[key, "spans", "masked"])

    rows = df.select(df[key].cast("long").alias(key), df[text].cast("string").alias("text"))
    return rows.mapInArrow(over, f"{key} long, spans array<struct<type:string,start:int,end:int>>, masked string")
