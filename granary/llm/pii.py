"""Personal data by weak supervision.

Patterns propose candidate spans.  Five labelers vote on each (for, against or not at all): its shape, a checksum or
range, a gazetteer, its context and its edges.  The corpus's counts of vote patterns, all documents', go to an
expectation-maximisation that estimates each labeler's reliability without labels; its posteriors train the final
span classifier, a logistic regression over votes and kinds.  Spans of the base kinds always stand; the other kinds
are added where the classifier accepts them.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .secrets import count_of, joined

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "local_phone", "ssn", "iban", "masked_email", "name")
#: What follows the at sign of an email address; what precedes it is the run of LOCAL characters before it.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digits, with three more dotted groups of digits if they follow: only then it is an address.
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![\w+.])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}(?![\w-])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
MASKED_AT = re.compile(r"\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?")
MASKED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?(?:dot|DOT)\x20?[\])])\x20?[A-Za-z0-9-]++)+")
NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-Z][a-zà-ÿ]+(?:\x20[A-Z][a-zà-ÿ]+)?")

#: Gazetteers.
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz co us it nl ch at be".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91".split())
IBAN_COUNTRIES = frozenset("DE FR ES GB IT NL BE CH AT PT IE LU PL SE DK NO FI".split())
GIVEN_NAMES = frozenset("james mary john anna peter maria thomas laura paul julia david sarah hans marie jean pierre carlos jose luis carmen klaus sabine".split())
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
CUES = {
    "email": "mail contact write address schreib escrib".split(),
    "masked_email": "mail contact write address schreib escrib".split(),
    "ip": "ip server host address network from".split(),
    "card": "card visa credit payment karte carte tarjeta".split(),
    "phone": "phone call tel mobile fax ruf".split(),
    "local_phone": "phone call tel mobile fax ruf".split(),
    "ssn": "ssn social security".split(),
    "iban": "iban bank account konto compte cuenta".split(),
    "name": "name dear sincerely by from signed".split(),
}
CONTEXT = 40  # characters before a candidate that are searched for cues


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _passes(kind: str, s: str) -> bool:
    """What a base kind's match must hold besides its pattern."""
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    if kind == "card":
        return 14 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(s)) <= 15
    return True


def _checked(kind: str, s: str) -> int:
    """The checksum or range labeler."""
    if kind == "iban":
        return 1 if _iban_holds(s) else -1
    if kind == "ssn":
        a, b, c = s.split("-")
        return 1 if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else -1
    if kind == "card":
        return 1
    if kind == "ip":
        return -1 if s.startswith(("0.", "255.")) else 1
    if kind in ("phone", "local_phone"):
        d = _digits(s)[-10:]
        return -1 if len(set(d)) <= 2 else 1 if kind == "local_phone" and d[0] not in "01" else 0
    return 0


def _listed(kind: str, s: str) -> int:
    """The gazetteer labeler."""
    if kind in ("email", "masked_email"):
        return 1 if re.split(r"[^A-Za-z0-9-]+", s.rstrip(")] "))[-1].lower() in DOMAINS else 0
    if kind == "phone":
        d = _digits(s)
        return 1 if any(d[:n] in CALLING_CODES for n in (1, 2)) else -1
    if kind == "iban":
        return 1 if s[:2] in IBAN_COUNTRIES else -1
    if kind == "card":
        return 1 if _digits(s).startswith(CARD_ISSUERS) else -1
    if kind == "name":
        return 1 if any(w.lower() in GIVEN_NAMES for w in s.split()[1:]) else 0
    return 0


def _votes(kind: str, text: str, start: int, end: int) -> str:
    """The five labelers' votes, as characters +, 0 and -."""
    s = text[start:end]
    before = text[max(0, start - CONTEXT) : start].lower()
    shape = 1 if kind in ("email", "ip", "phone", "iban", "masked_email") else 1 if kind == "card" and len(_digits(s)) in (15, 16) else 0
    edges = [c for c in (text[start - 1 : start], text[end : end + 1]) if c]
    votes = (
        shape,
        _checked(kind, s),
        _listed(kind, s),
        1 if any(c in before for c in CUES[kind]) else 0,
        -1 if any(c.isalnum() or c == "_" for c in edges) else 1,
    )
    return "".join("-0+"[v + 1] for v in votes)


def _addresses(text: str, signs, domain: re.Pattern) -> list[tuple[int, int]]:
    """Spans of a run of LOCAL characters, a sign (its spans are given, in order) and a domain.

    As a run ends where its sign begins, the leftmost match starts where the sign's run does, or where the match before
    ended; every character is looked at a bounded number of times.
    """
    out, done = [], 0
    for at, then in signs:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := domain.match(text, then)):
            out.append((start, m.end()))
            done = m.end()
    return out


def emails(text: str) -> list[tuple[int, int]]:
    return _addresses(text, (m.span() for m in re.finditer("@", text)), DOMAIN)


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if m[1]]


def _apart(spans: list, taken: list[tuple[int, int]]) -> list:
    """The spans (kind, start, end, ..) that touch no taken stretch."""
    merged: list[list[int]] = []
    for a, b in sorted(taken):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    return [s for s in spans if not (k := bisect.bisect_left(starts, s[2])) or merged[k - 1][1] <= s[1]]


def _pattern_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by start, then kind as listed."""
    base, more = [], []
    matches = lambda pattern: [m.span() for m in pattern.finditer(text)]
    add = lambda kind, spans: base.extend((kind, a, b, True) for a, b in spans if _passes(kind, text[a:b]))
    also = lambda kind, spans: more.extend((kind, a, b, False) for a, b in spans)
    if "@" in text:
        add("email", emails(text))
    if re.search("[0-9]", text):
        add("ip", ips(text))
        add("card", matches(CARD))
        add("phone", matches(PHONE))
        for kind, pattern in (("local_phone", LOCAL_PHONE), ("ssn", SSN), ("iban", IBAN)):
            also(kind, matches(pattern))
    if "[" in text or "(" in text:
        also("masked_email", _addresses(text, (m.span() for m in MASKED_AT.finditer(text)), MASKED_DOMAIN))
    if any(t in text for t in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor")):
        also("name", matches(NAME))
    out = base + _apart(more, [s[1:3] for s in base])
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates_in(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, votes) of every candidate in a text."""
    return [(k, a, b, base, _votes(k, text, a, b)) for k, a, b, base in _pattern_spans(text)]


_FIELDS = ("kind", "start", "end", "base", "votes")
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string())]))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (kind, start, end, base, votes) for each row of documents.

    A null or empty text has none; repeated rows get equal rows; an empty table gives none; other columns are not read.
    """

    def run(batches):
        for b in batches:
            found = [[dict(zip(_FIELDS, s)) for s in candidates_in(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean, votes: string>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


#: What is believed of the labelers (shape, checksum, gazetteer, context, edges) before any vote is seen: the chances
#: of votes -, 0 and + given a true span, and given a false one; worth so many votes each.
PRIORS = (
    ((0.05, 0.35, 0.60), (0.10, 0.50, 0.40)),
    ((0.01, 0.29, 0.70), (0.65, 0.30, 0.05)),
    ((0.05, 0.35, 0.60), (0.40, 0.40, 0.20)),
    ((0.05, 0.45, 0.50), (0.10, 0.80, 0.10)),
    ((0.04, 0.01, 0.95), (0.39, 0.01, 0.60)),
)
PRIOR_VOTES = 20


def aggregate_votes(counts: dict[tuple[str, str], int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, votes) by expectation-maximisation: a prior for each kind, and for each labeler the
    chances of its votes given a true and a false span (independent given the truth, drawn towards PRIORS)."""
    keys = sorted(counts)
    if not keys:
        return {}
    n = np.array([counts[k] for k in keys], dtype=float)
    votes = np.array([["-0+".index(c) for c in v] for _, v in keys])
    kinds = np.array([KINDS.index(k) for k, _ in keys])
    beliefs = PRIOR_VOTES * np.array(PRIORS)
    p = np.zeros(len(keys))
    for step in range(rounds):
        q = n * p * (step > 0)
        prior = np.array([(1 + q[kinds == k].sum()) / (2 + (step > 0) * n[kinds == k].sum()) for k in range(len(KINDS))])
        odds = np.log(prior[kinds] / (1 - prior[kinds]))
        for j in range(votes.shape[1]):
            yes = beliefs[j, 0] + np.bincount(votes[:, j], q, 3)
            no = beliefs[j, 1] + np.bincount(votes[:, j], (step > 0) * n - q, 3)
            odds += np.log((yes / yes.sum()) / (no / no.sum()))[votes[:, j]]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, p.tolist()))


def _features(keys: list[tuple[str, str]]) -> np.ndarray:
    out = np.zeros((len(keys), 1 + len(KINDS) + 3 * 5))
    out[:, 0] = 1
    for row, (kind, votes) in zip(out, keys):
        row[1 + KINDS.index(kind)] = 1
        for j, c in enumerate(votes):
            row[1 + len(KINDS) + 3 * j + "-0+".index(c)] = 1
    return out


def train(counts: dict[tuple[str, str], int], steps: int = 30, ridge: float = 1.0) -> np.ndarray:
    """The span classifier's weights: Newton steps of a ridge logistic regression on the posteriors, by counts."""
    soft = aggregate_votes(counts)
    keys = sorted(soft)
    x, y, n = _features(keys), np.array([soft[k] for k in keys]), np.array([counts[k] for k in keys], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(steps if keys else 0):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
    return w


def accepted(found: DataFrame) -> list[str]:
    """The ``kind:votes`` of added kinds that the classifier, trained on all candidates' votes, accepts.

    Five labelers of three votes make 243 patterns of each kind at most, so the counts are a bounded table.
    """
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    counts = {(r["kind"], r["votes"]): r["count"] for r in rows}
    w = train(counts)
    keys = [k for k in sorted(counts) if k[0] not in BASE_KINDS]
    score = _features(keys) @ w if keys else []
    return [":".join(k) for k, s in zip(keys, score) if s >= 0]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (kind, start, end): the base kinds' spans, and the accepted spans of the added kinds.

    A null or empty text has no spans; repeated rows get equal rows; an empty table gives none; a null doc_id stays
    null; other columns are not read.  Equal candidates have equal votes, so ties are decided alike.
    """
    found = materialise(candidates(docs))
    good = accepted(found)
    keep = F.filter("spans", lambda s: s["base"] | F.concat_ws(":", s["kind"], s["votes"]).isin(*good) if good else s["base"])
    return found.select("doc_id", F.transform(keep, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the base spans' digest and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [count_of(k) for k in BASE_KINDS]
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redacted(text: str, good: frozenset[str]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, they become one."""
    out, at = [], 0
    for kind, start, end, base, votes in candidates_in(text):
        if not base and f"{kind}:{votes}" not in good:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced; same columns and rows, ``n_chars`` (if there) counted anew.

    Null texts stay null, empty ones empty; repeated rows and rows without a doc_id are treated like any other; an empty
    table gives no rows.
    """
    good = frozenset(accepted(materialise(candidates(docs))))
    at = docs.columns.index("text")
    target = docs.schema

    def run(batches):
        for b in batches:
            texts = pa.array([None if (t := x.as_py()) is None else redacted(t, good) for x in b.column(at)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    out = docs.mapInArrow(run, target)
    return out.withColumn("n_chars", F.length("text").cast(target["n_chars"].dataType)) if "n_chars" in docs.columns else out
