"""Personal data by weak supervision.

Exact detectors give the base spans. Looser patterns propose further candidates. Regex, gazetteer and context labelers
vote on every candidate of the corpus; expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability and the candidates' probabilities, which train a logistic span classifier. Candidates it accepts
are added; base spans always stay. A candidate's votes and shape form one small integer, so what leaves the executors is
a histogram of at most MOST_CODES rows, counted over all documents.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

KINDS = ("email", "ip", "card", "phone", "national_id", "iban")
BASE = KINDS[:4]
# Generic top-level domains (those of countries come from Java's table), country calling codes, card issuer
# digits, and the length of each country's IBAN.
DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel asia cat post app dev page blog shop store online site "
    "website tech cloud email web xyz top club live news media world today agency digital systems solutions services network studio design "
    "company group ltd inc llc bank health care clinic legal law school university academy art music film games link click one space fun icu "
    "vip work life city team support center global international foundation ngo ong church family eco bio farm restaurant cafe hotel tours "
    "events photo photography video radio social chat wiki review guide tips expert consulting finance money insurance software engineering "
    "london berlin paris tokyo nyc amsterdam wien hamburg koeln zuerich madrid barcelona istanbul moscow sydney melbourne quebec scot wales eus gal bzh".split()
)
CALLING_ONE = frozenset("17")
CALLING_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CALLING_THREE = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())  # and a third digit
CALLING_NONE = frozenset("210 214 215 217 219 259 292 293 294 295 296 384 388 422 424 425 426 427 428 429 671 684 693 694 695 696 697 698 699 801 802 803 804 805 806 807 809 851 854 857 858 859 871 872 873 874 875 876 877 879 884 885 887 889 969 978 990 991 997 999".split())
ISSUERS = tuple("30 34 35 36 37 38 39 4 22 23 24 25 26 27 50 51 52 53 54 55 56 57 58 60 62 63 64 65 67".split())
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
        "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 "
        "PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
# Context words by kind, and words that speak against any.
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "write to"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "national_id": ("ssn", "social security", "national id"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
}
AGAINST = ("version", "isbn", "issn", "order", "serial", "invoice", "part no", "build", "release")
LABELERS, LENGTHS, DIGITS = 5, 4, 4
MOST_CODES = len(KINDS) * 3**LABELERS * LENGTHS * DIGITS
#: A candidate outside the base is added from this probability on.
ACCEPT = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does: a run that fails from its start fails from within.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SOME = re.compile(r"[@0-9]|[\[(]at[\])]")
LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9_%+-]{1,64}(?:\.[A-Za-z0-9_%+-]{1,64}){0,5} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63} ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,10}(?![A-Za-z])")),
    ("phone", re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("national_id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches; every '@' looks back over its own run of local characters only, so the time is linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or 0) <= 255


def base_spans(text: str) -> tuple[list, list]:
    """Base spans (kind, start, end) by kind then start, and card-like matches that fail the check."""
    if not SOME.search(text):
        return [], []
    spans, failed = [("email", *x) for x in emails(text)], []
    for m in IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                (spans if luhn(digits) else failed).append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans, failed


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def has_calling_code(digits: str) -> bool:
    """Country codes are prefix-free: one digit, two, or three."""
    if digits[:1] in CALLING_ONE or digits[:2] in CALLING_TWO:
        return True
    return digits[:2] in CALLING_THREE and digits[:3] not in CALLING_NONE


def listed_in(kind: str, s: str, countries: frozenset[str]) -> int:
    """What the gazetteers say: 1 for, -1 against, 0 nothing."""
    if kind == "email":
        last = re.split(r"[^A-Za-z]+", s)[-1].lower()
        return 1 if last in DOMAINS or last in countries else -1
    if kind == "card":
        return 1 if s.startswith(ISSUERS) else -1
    if kind == "iban":
        return 1 if IBAN_LENGTHS.get(s[:2]) == len(s.replace(" ", "")) else -1
    if kind == "national_id":
        area, group, serial = s.split("-")
        return -1 if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else 1
    if kind == "phone":
        digits = re.sub(r"[^0-9]", "", s)
        if s[0] == "+":
            return 1 if has_calling_code(digits) else -1
        return 1 if digits[0] in "23456789" and digits[3] in "23456789" else 0
    return 0


def votes(text: str, kind: str, start: int, end: int, checked: int, countries: frozenset[str] = frozenset()) -> list[int]:
    """-1, 0 or 1 of: validating regex, gazetteer, context words, contrary context, boundaries."""
    before = text[max(0, start - 40) : start].lower()
    near = 1 if any(w in before for w in CONTEXT[kind]) else 0
    contrary = -1 if any(w in before for w in AGAINST) else 0
    edge = -1 if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() else 1
    return [checked, listed_in(kind, text[start:end], countries), near, contrary, edge]


def code_of(kind: str, vote: list[int], s: str) -> int:
    n = 0
    for v in vote:
        n = n * 3 + v + 1
    digits = sum(c.isdigit() for c in s)
    return ((KINDS.index(kind) * 3**LABELERS + n) * LENGTHS + min(3, len(s) // 10)) * DIGITS + min(3, 4 * digits // max(1, len(s)))


def candidates(text: str, countries: frozenset[str] = frozenset()) -> tuple[list, list]:
    """Base spans, and all candidates (kind, start, end, code, is base); others overlap neither the base nor one another."""
    base, failed = base_spans(text)
    out = [(k, a, b, code_of(k, votes(text, k, a, b, 1, countries), text[a:b]), True) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    loose = [(*x, -1) for x in failed]
    if SOME.search(text):
        for kind, pattern in LOOSE:
            loose += [(kind, *m.span(), (1 if iban_ok(m[0]) else -1) if kind == "iban" else 0) for m in pattern.finditer(text)]
    loose.sort(key=lambda x: (x[1], -x[2]))
    i, last = 0, 0
    for kind, a, b, checked in loose:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a < last or i < len(taken) and taken[i][0] < b:
            continue
        last = b
        out.append((kind, a, b, code_of(kind, votes(text, kind, a, b, checked, countries), text[a:b]), False))
    return base, out


def features(code: int) -> tuple[int, list[int], int, int]:
    code, digits = divmod(code, DIGITS)
    code, length = divmod(code, LENGTHS)
    kind, n = divmod(code, 3**LABELERS)
    vote = []
    for _ in range(LABELERS):
        n, v = divmod(n, 3)
        vote.append(v)
    return kind, vote[::-1], length, digits


def design(codes: list[int]) -> np.ndarray:
    rows = np.zeros((len(codes), 1 + len(KINDS) + 3 * LABELERS + LENGTHS + DIGITS))
    for row, code in zip(rows, codes):
        kind, vote, length, digits = features(code)
        row[[0, 1 + kind, *(1 + len(KINDS) + 3 * j + v for j, v in enumerate(vote)), 1 + len(KINDS) + 3 * LABELERS + length, 1 + len(KINDS) + 3 * LABELERS + LENGTHS + digits]] = 1
    return rows


class SpanModel:
    """Labeler reliabilities by expectation-maximisation, then a ridge logistic regression on the probabilities."""

    #: Votes that each labeler is taken to have cast before any data: mostly right.
    PRIOR = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])

    def __init__(self, counts: dict[int, int], rounds: int = 50, countries: frozenset[str] = frozenset()):
        self.countries = countries
        codes = sorted(counts)
        n = np.array([counts[c] for c in codes], float)
        vote = np.array([features(c)[1] for c in codes]).reshape(-1, LABELERS)
        # the contrary and boundary labelers never lean on their own: a vote for is weak evidence
        p = 1 / (1 + np.exp(-(vote - 1).sum(1))) if len(codes) else n
        self.reliability = np.tile(self.PRIOR / self.PRIOR.sum(1, keepdims=True), (LABELERS, 1, 1))
        for _ in range(rounds if len(codes) else 0):
            share = (n @ p + 1) / (n.sum() + 2)
            table = np.zeros((LABELERS, 2, 3)) + self.PRIOR
            for j in range(LABELERS):
                for v in range(3):
                    m = vote[:, j] == v
                    table[j, 1, v] += n[m] @ p[m]
                    table[j, 0, v] += n[m] @ (1 - p[m])
            self.reliability = table / table.sum(2, keepdims=True)
            logs = np.log(self.reliability)
            odds = np.log(share / (1 - share)) + sum(logs[j, 1, vote[:, j]] - logs[j, 0, vote[:, j]] for j in range(LABELERS))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        x = design(codes)
        self.weights = np.zeros(design([0]).shape[1])
        for _ in range(25 if len(codes) else 0):
            q = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            grad = x.T @ (n * (p - q)) - self.weights
            hess = (x * (n * q * (1 - q))[:, None]).T @ x + np.eye(len(self.weights))
            self.weights += np.linalg.solve(hess, grad)
        self._known: dict[int, float] = {}

    def __call__(self, code: int) -> float:
        if code not in self._known:
            self._known[code] = float(1 / (1 + np.exp(-np.clip(design([code]) @ self.weights, -30, 30))[0]))
        return self._known[code]


def fit(docs: DataFrame) -> SpanModel:
    """Vote patterns of all candidates of all documents, counted; then the model."""
    countries = frozenset(c.lower() for c in docs.sparkSession._jvm.java.util.Locale.getISOCountries()) | {"eu", "su", "uk"}

    def run(batches):
        seen: dict[int, int] = {}
        for b in batches:
            for text in b.column("text").to_pylist():
                for *_, code, _ in candidates(text, countries)[1]:
                    seen[code] = seen.get(code, 0) + 1
        yield {"code": list(seen), "n": list(seen.values())}

    counts = map_batches(texts(docs).select("text"), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return SpanModel({r["code"]: r["n"] for r in counts.collect()}, countries=countries)  # MOST_CODES rows at most


def find(text: str, model: SpanModel) -> tuple[list, list]:
    """Base spans and all spans, each by kind then start."""
    base, found = candidates(text, model.countries)
    spans = [(k, a, b) for k, a, b, code, own in found if own or model(code) >= ACCEPT]
    return base, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans (code points, end exclusive).

    A null or empty text has no spans; a null doc_id is carried; repeated rows are reported each; of candidates that begin
    at one place (ties) the longest stays, and base spans before all; very long texts take linear time; an empty table gives no rows; other columns are ignored.
    """
    model = model or fit(docs)

    def run(batches):
        for b in batches:
            out = {n: [] for n in (*(f"n_{k}" for k in BASE), "base_sha256", "spans")}
            for text in b.column("text").to_pylist():
                base, spans = find(text, model)
                for k in BASE:
                    out[f"n_{k}"].append(sum(x[0] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            yield out | {"doc_id": b.column("doc_id")}

    return map_batches(texts(docs), run, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def redacted(text: str, spans: list) -> str:
    """Each span becomes <kind>; of overlapping spans the union does, under the first one's name."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The documents, all columns as they are, with spans in text replaced; n_chars, if there, is the new length. Null texts stay null."""
    model = model or fit(docs)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            new = [None if t is None else redacted(t, find(t, model)[1]) if SOME.search(t) else t for t in b.column(at).to_pylist()]
            cols = b.columns
            cols[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    from .common import small_batches

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
