"""Operator 5: personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in one pass over each whole text: at-signs, plus signs, digits, ``://`` and the cue words of account and street
numbers. From each anchor a small parser expands to the left and right, and validates what it finds (domain, octets, Luhn, digit counts, IBAN check digits).

``KINDS`` are found in the order listed. The first four are the base kinds: leftmost, non-overlapping per kind; a match that fails its test is dropped and the search goes on behind it.
Edge cases: a null text counts as empty and has no spans; repeated rows and null doc_ids give results like any other row; spans of one kind never overlap, and those of different kinds that begin at one place are in the order of ``KINDS``; very long runs of digits or letters are skipped in one step, so the time is
linear, and a street's name may be of any length; a very long text is a slice of its own; an empty table gives no rows; columns other than doc_id and text are ignored by ``scan`` and passed on by ``redact``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import table, text_slices

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account", "address")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"://([^\s/@:?#]+:[^\s/@?#]+)@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[:\s]{1,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|#))?[ :#]{1,3}([0-9]{6,15})(?![0-9])", re.I)
DIGITS = "0123456789"
SLICE_CHARS = 4_000_000
CUES = {"IBAN": "iban", "iban": "iban", "account": "account", "Account": "account", " Street": "street", " Avenue": "street", " Road": "street", " Boulevard": "street"}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in ({"@": "@", "+": "+", "://": "://"} | {d: "digit" for d in DIGITS} | CUES).items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def street_start(text: str, end: int, low: int) -> int | None:
    """Where the number of a street begins whose name ends before ``end``: a number of one to five digits, then one to three capitalised words, each behind a space. The most words that fit count. Nothing before ``low`` is looked at."""
    found, at = None, end
    for _ in range(3):
        first = at
        while first > low and "a" <= text[first - 1] <= "z":
            first -= 1
        if first == at or first - 2 < low or not "A" <= text[first - 1] <= "Z" or text[first - 2] != " ":
            break
        at = first - 2
        number = at
        while number > low and at - number < 5 and text[number - 1] in DIGITS:
            number -= 1
        found = number if number < at else found
    return found


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where a kind's next match may begin

    def put(kind: str, start: int, end: int, good: bool = True) -> None:
        free[kind] = end
        if good:
            spans[kind].append((start, end))

    for last, (anchor, size) in anchors.iter(text):
        at = last + 1 - size
        if anchor == "digit":
            if at >= free["card"]:
                if m := CARD.match(text, at):
                    digits = re.sub("[ -]", "", m[0])
                    put("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
                else:
                    free["card"] = at + 1
            if at >= free["ip"]:
                if m := IP.match(text, at):
                    put("ip", at, m.end(), all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")))
                else:
                    end = at + 1
                    while end < len(text) and text[end] in DIGITS:
                        end += 1
                    free["ip"] = end  # no start within the run can match either
        elif anchor == "@":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                put("email", start, m.end())
            else:
                free["email"] = max(free["email"], at + 1)  # what stands before this sign can't begin a match
        elif anchor == "+":
            if at >= free["phone"] and (m := PHONE.match(text, at)):
                put("phone", at, m.end(), 8 <= sum(c in DIGITS for c in m[0]) <= 15)
        elif anchor == "://":
            if at >= free["login"] and (m := LOGIN.match(text, at)):
                put("login", *m.span(1))
        elif anchor == "iban":
            if at >= free["iban"] and (m := IBAN.match(text, last + 1)) and iban_ok(m[1]):
                put("iban", *m.span(1))
        elif anchor == "account":
            if at >= free["account"] and (m := ACCOUNT.match(text, last + 1)):
                put("account", *m.span(1))
        elif at >= free["address"] and not text[last + 1 : last + 2].isalnum() and (start := street_start(text, at, free["address"])) is not None:
            put("address", start, last + 1)
    return [(kind, *s) for kind in KINDS for s in spans[kind]]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) with the spans as an array of (kind, start, end_)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end_", pa.int32())]))
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), SLICE_CHARS):
                found = [[{"kind": k, "start": x, "end_": y} for k, x, y in find(t or "", anchors)] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end_: int>>")


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each span of personal data, overlapping ones together, replaced by ``<KIND>``; ``n_chars`` follows the text where there is one. Null texts stay null."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()

        def clean(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for kind, start, end in sorted(find(text, anchors), key=lambda s: (s[1], -s[2])):
                if start >= at:
                    out += [text[at:start], f"<{kind.upper()}>"]
                at = max(at, end)
            return "".join([*out, text[at:]])

        for batch in batches:
            k = batch.schema.get_field_index("text")
            for a, b, texts in text_slices(batch.column(k), SLICE_CHARS):
                yield batch.slice(a, b - a).set_column(k, batch.schema.field(k), pa.array([clean(t) for t in texts], batch.schema.field(k).type))

    out = docs.mapInArrow(run, fields)
    return out.withColumn("n_chars", F.length("text").cast(fields["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end_"])), ",")


def op5_anchor_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
