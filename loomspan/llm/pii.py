"""Personal data: plain identifiers, and disguised ones found in a normalised text and mapped back to source characters.

Plain (base) identifiers are the leftmost non-overlapping matches of one pattern per kind in the text as it is.
For the disguised ones a chain of transducers rewrites the text: look-alike characters become ASCII, invisible ones vanish,
spelled digits become digits, "at" and "dot" disguises become signs. Each step keeps, for every character it writes, the
source characters that it stands for, so a match in the normalised text is a span of the source. Detection is then the
same as for plain text; what is new (overlaps no base span of its kind) is added. A cheap test for any disguise sign
keeps ordinary texts out of the transducers.

Work and memory of a task grow with its texts only; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import binary_rows, map_batches, read
from loomspan.llm.registry import query

KINDS = ("email", "ip", "card", "phone")

# Plain identifiers ------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def emails(text: str) -> list[tuple[int, int]]:
    """Matches around each @: the run of local characters before it and a dotted domain behind it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            end = found.end()
            out.append((begin, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers; a run of digits is tried from its start only: a match from inside it would fail as well."""
    return [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]


def luhn(digits: str) -> bool:
    ones = sum(map(int, digits[-1::-2]))
    return (ones + sum(_DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]


DETECT = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain identifiers, in order."""
    digits = _DIGIT.search(text) is not None
    found = [(s, 0, e) for s, e in emails(text)]
    if digits:
        found += [(s, k, e) for k in (1, 2, 3) for s, e in DETECT[k](text)]
    return sorted(found)


# Transducers: (characters, source starts, source ends) to the same ---------------------------------------

#: Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "·": ".", "＠": "@", "﹫": "@",
    " ": " ", " ": " ", " ": " ", " ": " ",
}
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
#: Spelled digits.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SIGN_WORDS = {"dot": ".", "punkt": ".", "point": ".", "punto": ".", "at": "@", "arroba": "@", "dash": "-", "plus": "+"}

_WIDE = "！-～\U0001d400-\U0001d7ff①-⒛²³¹⁰-₉٠-٩۰-۹०-९"
_ODD = re.compile(f"[{''.join(map(re.escape, LOOKALIKES))}{INVISIBLE}{_WIDE}]")
_DOT = "dot|punkt|point|punto"
_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_PART = rf"(?:[ .,-]{{1,2}}(?:{_NUMBER}|[0-9]+|{_DOT}|dash)(?![^\W_]))"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus{_PART}+|(?:{_NUMBER}|[0-9]+){_PART}{{3,}})", re.I)
_SPELLED_PART = re.compile(rf"plus|{_NUMBER}|[0-9]+|{_DOT}|dash", re.I)
_BRACKETED = re.compile(rf"[ \t]?[\[({{<][ \t]?(at|arroba|@|{_DOT}|\.)[ \t]?[\])}}>][ \t]?", re.I)
_BRACKET_SIGN = re.compile(rf"[\[({{<][ \t]?(?:at|arroba|@|{_DOT}|\.)[ \t]?[\])}}>]")
_NAME = r"[A-Za-z0-9_%+-]+"
_SPACED = re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?: (?:{_DOT}) |\.){_NAME})*(?: (?:at|arroba) | ?@ ?)[A-Za-z0-9-]+(?:(?: (?:{_DOT}) |\.)[A-Za-z0-9-]+)+", re.I)
_SPACED_PART = re.compile(rf" ({_DOT}|at|arroba) | ?(@) ?|(\.)", re.I)
_DOT_WORD = re.compile(rf" (?:{_DOT}) ", re.I)
#: An ending after which "name at domain.ending" is read as an address without a spelled dot.
_ENDING = re.compile(r"\.([a-z]{2,6})\Z", re.I)
#: Endings that follow any name; words that open a sentence behind "at home.", of which those of two letters are endings of countries;
#: what is often behind "at", and before it, in running text.
_COMMON_ENDINGS = frozenset("com org net edu gov info io de fr es uk".split())
_OPENERS = frozenset(
    "a ab aber al als also am an and any are as at auf aus away back be bei bis but by can car come dann das de del den der des did die do does don each el "
    "elle en er es et for from go had has have he her here his how i if il ils in is it its je just la las le les let lo los ma mais man many may me mit more "
    "most my no nor not now of off oft oh ok on one only or our out over pero por quand que she sie so some soon still such tell than that the their them then "
    "there these they this those to too two un und une up us very was we well went were what when where which while who why wie will wir with would yes yet "
    "you your".split())
_PLACES = frozenset(
    "all anchor bay best breakfast church college court dawn day dinner dusk ease end first gate hand heart home hospital hotel house issue large last least "
    "length lunch midnight most night noon odds office once party peace present random rest risk school sea sight stake station table that them this times "
    "university us war will work".split())
_BEFORE_AT = frozenset(
    "all and angry are arrive arrived be been being but called came am eat ended everyone fell good he held her here him i is it laugh laughed left live lived "
    "look looked looking looks me meet met not now off only or out sat shop shout she shown sleep start started stay stayed staying stop stopped that them there "
    "they this time up us wait waited was we were while who work worked working works you".split())
_AT_DOMAIN = re.compile(r" (?:at|arroba) [a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]")
_DOTTED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?: (?:{_DOT}) | ?[\[(]\.[\])] ?)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_DOT_WORDS = frozenset(_DOT.split("|"))
_NUMBER_WORDS = frozenset(DIGIT_WORDS) | {"plus"}
_RUN_WORDS = _NUMBER_WORDS | _DOT_WORDS | {"dash"}
_WORDS = re.compile(r"[^\W_]+")


def _number_run(words: list[str]) -> bool:
    """Whether "plus" and a part of a number, or four parts in a row, may be what _SPELLED takes: numbers, spelled or not, dots and dashes."""
    run = 0
    for w in words:
        run = (4 if w == "plus" else run + 1) if w in _RUN_WORDS or w.isdigit() else 0
        if run >= 4:
            return True
    return False


def maybe_disguised(text: str) -> bool:
    """A cheap test that no text with a disguised identifier fails."""
    if not text.isascii() and _ODD.search(text):
        return True
    low = text.lower()
    if not text.isascii():
        low = low.replace("\u017f", "s").replace("i\u0307", "i")  # letters that patterns without case take for s and i
    if " @" in low or "@ " in low or _BRACKET_SIGN.search(low) or _AT_DOMAIN.search(low):
        return True
    words = _WORDS.findall(low)
    if not _NUMBER_WORDS.isdisjoint(words) and _number_run(words):
        return True
    return not _DOT_WORDS.isdisjoint(words)


class Tape:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Puts each (start, end, new) in place, in order; new characters share the span of what they replace."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text.append(self.text[at:s])
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            text.append(new)
            starts += [self.starts[s]] * len(new)
            ends += [self.ends[e - 1]] * len(new)
            at = e
        text.append(self.text[at:])
        return Tape("".join(text), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.starts[s], self.ends[e - 1]


def look_alikes(tape: Tape) -> Tape:
    """Look-alike, wide and styled characters to ASCII; invisible ones to nothing."""
    def plain(c: str) -> str:
        if c in INVISIBLE:
            return ""
        return LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c) if not c.isdecimal() else str(unicodedata.decimal(c))
    return tape.rewrite([(m.start(), m.end(), plain(m[0])) for m in _ODD.finditer(tape.text)])


def spelled_digits(tape: Tape) -> Tape:
    """Runs of at least four spelled digits or numbers, or of "plus" and what follows, with at least one spelled, to digits."""
    edits = []
    for run in _SPELLED.finditer(tape.text):
        parts = list(_SPELLED_PART.finditer(run[0]))
        if not any(p[0].lower() in _NUMBER_WORDS for p in parts):
            continue
        written = ""
        for p in parts:
            word = p[0].lower()
            written += _SIGN_WORDS.get(word) or DIGIT_WORDS.get(word, word)
        edits.append((run.start(), run.end(), written))
    return tape.rewrite(edits)


def bracketed_signs(tape: Tape) -> Tape:
    """[at], (dot) and the like to signs, with the blanks around them."""
    return tape.rewrite([(m.start(), m.end(), _SIGN_WORDS.get(m[1].lower(), m[1])) for m in _BRACKETED.finditer(tape.text)])


def plain_address(address: str) -> bool:
    """Whether "name at domain.ending" is an address: by a common ending, a name with digits or signs, or words unlike running text."""
    found = _ENDING.search(address)
    if not found:
        return False
    ending, name, place = found[1].lower(), address[: address.index(" ")].lower(), address[address.rindex(" ") + 1 : found.start()].lower()
    if ending in _COMMON_ENDINGS or not name.isalpha():
        return True
    return name not in _BEFORE_AT and (ending not in _OPENERS or len(ending) == 2 and place not in _PLACES)


def spaced_signs(tape: Tape) -> Tape:
    """ " at " and " dot " inside what then is an address, and blanks around its signs."""
    edits = []
    for address in _SPACED.finditer(tape.text):
        if " " not in address[0] or not ("@" in address[0] or _DOT_WORD.search(address[0]) or plain_address(address[0])):
            continue
        for p in _SPACED_PART.finditer(address[0]):
            sign = (p[1] or p[2] or p[3]).lower()
            edits.append((address.start() + p.start(), address.start() + p.end(), _SIGN_WORDS.get(sign, sign)))
    for address in _DOTTED_IP.finditer(tape.text):
        for p in re.finditer(r"[^0-9]+", address[0]):
            edits.append((address.start() + p.start(), address.start() + p.end(), "."))
    kept, end = [], 0
    for edit in sorted(edits):
        if edit[0] >= end:
            kept.append(edit)
            end = edit[1]
    return tape.rewrite(kept)


def disguised_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in source characters of identifiers that show only in the normalised text."""
    if not maybe_disguised(text):
        return []
    tape = spaced_signs(bracketed_signs(spelled_digits(look_alikes(Tape(text)))))
    if tape.text == text:
        return []
    taken: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    for s, k, e in base:
        taken[k].append((s, e))
    out = []
    for k, detect in enumerate(DETECT):
        known = taken[k]
        i = 0
        for a, b in detect(tape.text):
            s, e = tape.source(a, b)
            while i < len(known) and known[i][1] <= s:
                i += 1
            if not (i < len(known) and known[i][0] < e):
                out.append((s, k, e))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text; null counts as empty."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, disguised_spans(text, base)


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    base, added = scan(text)
    if not base and not added:
        return text
    out, at = [], 0
    for s, k, e in sorted(base + added):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans per kind, hash of the base spans, and all spans, for every row.

    Null and empty texts have no spans, so the hash is that of the empty string. Repeated rows give repeated results.
    """
    def step(batch):
        columns = [[] for _ in range(7)]
        for raw in binary_rows(batch, "text"):
            base, added = scan(raw.decode() if raw else None)
            for k in range(4):
                columns[k].append(sum(x[1] == k for x in base))
            columns[4].append(hashlib.sha256(written(base).encode()).hexdigest())
            columns[5].append(written(sorted(base + added)))
            columns[6].append(len(added))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:6]], pa.array(columns[6], pa.int64())],
            names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, step, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with all columns, spans in text replaced by their kind."""
    def step(batch):
        at = batch.schema.get_field_index("text")
        texts = pa.array([redacted(raw.decode() if raw is not None else None) for raw in binary_rows(batch, "text")], pa.string())
        return batch.set_column(at, "text", texts)

    return map_batches(docs, step, docs.schema)


@query("op4_pii_spans")
def op4_pii_spans(spark, sf_dir):
    return find(read(spark, sf_dir, "documents", "doc_id", "text"))
