"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over the text finds anchors: at-signs, plus signs before a digit, digits, schemes and
words that announce an identifier. From an anchor a local parser goes left and right to the bounds of an email address, an
IP address, a card or a phone number, a web address with a user's name in it, an account number or a secret, and checks it
(parts of an IP, Luhn's sum, the digits of a phone, mod 97 of an IBAN). Nothing else of the text is looked at.

Base kinds: email, ip, card, phone, by the patterns given with `scan`; added kinds: url, iban, secret. Spans count
code points, the end is exclusive. Null and empty texts have none, very long ones are scanned whole. A row's spans depend on its
text alone, so ties and repeated rows have the same; an empty table gives an empty one. The document travels as one struct, so its
other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: The order of kinds in a span list.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "secret")
#: Schemes, and words that announce an identifier or a secret.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("IBAN", "iban", "password", "passwd", "token", "api_key", "apikey", "secret", "AKIA", "sk-", "ghp_")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:https?|ftp)://[^\s<>\"']*[^\s<>\"'.,;:!?)]|mailto:[^\s<>\"'@]+@[A-Za-z0-9.-]*[A-Za-z0-9]")
_IBAN = re.compile(r"[\x20:=]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_KEY = re.compile(r"(?:password|passwd|token|api_key|apikey|secret)\x20?[=:]\x20?[\"']?([A-Za-z0-9_+/.-]{8,})")
_BARE = re.compile(r"AKIA[A-Z0-9]{16}|sk-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_DIGITS = re.compile("[0-9]+")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, kind in [("@", "@"), ("+", "+"), *((str(d), "0") for d in range(10)), *((s, "url") for s in SCHEMES), *((c, "cue") for c in CUES)]:
        a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def scan(text: str | None, machine) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), sorted by start, then kind. Base kinds are leftmost and don't overlap within a kind:
    email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, ip of four parts up to 255, card of 12 to 19 digits passing
    Luhn, phone of 9 to 15 digits after a plus. A match that fails its check is passed over as a whole."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, kept or not
    run = 0  # end of the last run of digits
    for last, (kind, width) in machine.iter(text):
        at = last - width + 1
        if kind == "0":
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, m.end()))
            if at >= run:
                run = _DIGITS.match(text, at).end()
                if at >= done["ip"] and (m := _IP.match(text, at)):
                    done["ip"] = m.end()
                    if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                        out.append(("ip", at, m.end()))
        elif kind == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", at, m.end()))
        elif kind == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                out.append(("email", start, m.end()))
        elif kind == "url":
            if at >= done["url"] and (m := _URL.match(text, at)):
                done["url"] = m.end()
                out.append(("url", at, m.end()))
        else:
            if (m := _IBAN.match(text, last + 1)) and text[at : last + 1].lower() == "iban" and m.start(1) >= done["iban"]:
                done["iban"] = m.end(1)
                if iban_ok(m[1]):
                    out.append(("iban", m.start(1), m.end(1)))
            if at >= done["secret"] and (m := _KEY.match(text, at) or _BARE.match(text, at)):
                done["secret"] = m.end()
                out.append(("secret", *m.span(m.lastindex or 0)))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first one."""
    if not text:
        return text
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{k}>"]
            at = e
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, masked: bool = False) -> DataFrame:
    """row (the document as a struct), spans (array of kind, start, end_) and, if asked for, masked: the text without them."""

    at = docs.columns.index("text")  # the text goes to Python once, inside the row

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end_", pa.int64())]))
        for b in batches:
            texts = b.column(0).field(at).to_pylist()
            found = [scan(t, machine) for t in texts]
            cols = [b.column(0), pa.array([[{"kind": k, "start": s, "end_": e} for k, s, e in x] for x in found], kind)]
            if masked:
                cols.append(pa.array([mask(t, x) for t, x in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["row", "spans", "masked"][: len(cols)])

    packed = docs.select(F.struct("*").alias("row"))
    shape = packed.select("row", F.expr("cast(null as array<struct<kind:string,start:bigint,end_:bigint>>)").alias("spans"), F.lit(None).cast("string").alias("masked"))
    return packed.mapInArrow(of, (shape if masked else shape.drop("masked")).schema)


def op6_pii(spark, sf_dir):
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    as_text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end_"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    added = F.size(F.filter("spans", lambda x: ~x["kind"].isin(*BASE_KINDS))).cast("long").alias("n_added")
    return found.select("row.doc_id", *(count(k) for k in KINDS), added, F.size("spans").cast("long").alias("n_spans"), F.sha2(F.array_join(F.transform(base, as_text), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", as_text), ",").alias("spans"))
