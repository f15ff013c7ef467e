"""Personal data in whole texts: patterns propose spans, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order of kinds, and words that speak for each within CONTEXT characters.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
CONTEXT_WORDS = {
    "email": ("mail", "email", "contact", "write", "correo", "adresse"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: Words that speak against each kind.
AGAINST = {
    "email": ("example", "package"),
    "ip": ("version", "release", "section", "chapter", "build"),
    "card": ("order", "invoice", "tracking", "isbn", "serial"),
    "phone": ("order", "invoice", "part", "version", "serial"),
    "iban": ("order", "invoice", "part", "serial", "model", "version"),
    "ssn": ("order", "invoice", "part", "serial", "model", "version"),
}
#: Score of a kind before its context: the stronger the check, the higher.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT, BONUS, LEAST = 40, 0.3, 0.5
#: Length of an IBAN by its country.
IBAN_LENGTH = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits begins, so no digit inside a run is tried again.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in range(15, 35)}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str):
    """Leftmost, non-overlapping: cut to the length of the country, so what follows a space is never taken in. A code
    without a known length takes the longest run of whole tokens that is confirmed."""
    low = 0
    for head in _IBAN.finditer(text):
        if head.start() >= low:
            known = IBAN_LENGTH.get(head[0][:2])
            for n in (known,) if known else range(34, 14, -1):
                m = _IBAN_REST[n].match(text, head.end())
                if m and mod97(text[head.start() : m.end()]):
                    yield head.start(), m.end()
                    low = m.end()
                    break


def _emails(text: str):
    """Leftmost, non-overlapping: the local part is the run before an at-sign, never shared between two."""
    low, at = 0, text.find("@")
    while at >= 0:
        local = text[low:at]
        start = low + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, sorted by start, then as BASE_KINDS lists the kinds."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    out.sort(key=lambda x: (x[0], BASE_KINDS.index(x[2])))
    return out


def scored_spans(text: str) -> list[tuple[int, int, str, float]]:
    """Base spans, which always stay, and confirmed ones of further kinds whose score is LEAST at least: a kind's prior,
    raised by words for it nearby and lowered by words against it."""
    spans = [(*s, True) for s in base_spans(text)]
    spans += [(*s, "iban", False) for s in _ibans(text)]
    spans += [(*m.span(), "ssn", False) for m in _SSN.finditer(text)]
    out = []
    for a, b, kind, stays in spans:
        near = {w.lower() for w in _WORD.findall(text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT])}
        score = round(min(1.0, max(0.0, PRIOR[kind] + BONUS * (bool(near & set(CONTEXT_WORDS[kind])) - bool(near & set(AGAINST[kind]))))), 2)
        if stays or score >= LEAST:
            out.append((a, b, kind, score))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _find(batches):
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "max_score")}
        for x in batch.column("text"):
            found = scored_spans(x.as_py() or "")
            base = [s for s in found if s[2] in BASE_KINDS]
            for k in BASE_KINDS:
                cols[f"n_{k}"].append(sum(s[2] == k for s in base))
            told = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)
            cols["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
            cols["spans"].append(told(found))
            cols["scores"].append(",".join(f"{x[3]:.2f}" for x in found))
            cols["max_score"].append(max((s[3] for s in found), default=None))
        types = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(cols.values(), types, strict=True))], ["doc_id", *cols])


def find_pii(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, max_score), one
    row per input row; scores has a score for each of spans. Null is the empty text: no spans, the digest of an empty
    string, null max_score."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, max_score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_find, schema)


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets; where spans overlap, the
    first one counts and takes in the others. Null texts stay null."""

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            out = []
            for x in batch.column(k):
                text, parts, last = x.as_py(), [], 0
                for a, b, kind, _ in scored_spans(text or ""):
                    if a >= last:
                        parts += [text[last:a], f"[{kind}]"]
                    last = max(last, b)
                out.append(None if text is None else "".join([*parts, text[last:]]))
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
