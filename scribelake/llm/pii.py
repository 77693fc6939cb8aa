"""Personal data (operator 1): anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, scheme separators, digits and identifier cues. A
deterministic parser then expands each anchor to the left and right and validates what it holds:

    at-sign  email
    digits   ip (parts to 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits after a plus), each within the
             longest run of characters that any of them may have, as those runs hold all their matches
    scheme   address: a web address that names a user or whose host is an IP address
    cue      account: the identifier behind a word such as "IBAN" (check digits must agree), "SSN", "password" or "token"
    shape    key: an access key, known by how its issuer lets it begin, and whole private-key blocks

Base kinds are leftmost and do not overlap within their kind; spans of different kinds may overlap. Positions are code
points, ends exclusive. Null and empty texts have no spans. Texts are read whole, in time and memory that grow with
their length. Repeated rows have the same spans. An empty table gives an empty one. Other columns of docs are kept by
redact and with_spans (which replaces a column of the name of its result) and ignored by the query.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account", "key")
# What identifier cues look like, in lower case.
CUES = (
    "iban", "ssn", "social security", "passport", "account", "acct", "customer id", "patient id", "mrn", "tax id", "konto", "cuenta",
    "compte", "password", "passwd", "passphrase", "api_key", "api-key", "api key", "apikey", "secret", "token", "bearer", "access key",
    "access_key", "accesskey", "private key", "private_key", "secret key", "secret_key",
)
# How access keys of well-known issuers begin, in lower case, and what follows.
SHAPES = {
    "akia": r"AKIA[0-9A-Z]{16}", "asia": r"ASIA[0-9A-Z]{16}", "aiza": r"AIza[0-9A-Za-z_-]{35}", "ghp_": r"ghp_[0-9A-Za-z]{36}", "gho_": r"gho_[0-9A-Za-z]{36}",
    "github_pat_": r"github_pat_[0-9A-Za-z_]{22,}", "glpat-": r"glpat-[0-9A-Za-z_-]{20,}", "sk-": r"sk-[0-9A-Za-z_-]{20,}", "sk_live_": r"sk_live_[0-9A-Za-z]{16,}",
    "xoxb-": r"xoxb-[0-9A-Za-z-]{20,}", "xoxp-": r"xoxp-[0-9A-Za-z-]{20,}", "eyj": r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "-----begin ": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----",
}
_PASSWORDS = frozenset(("password", "passwd", "passphrase"))
_SECRETS = frozenset(c for c in CUES if c in _PASSWORDS or "key" in c or c in ("secret", "token", "bearer"))
_SHAPES = {k: re.compile(v) for k, v in SHAPES.items()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_NUMERIC = frozenset("0123456789 ().+-")
_NUMERIC_RUN = re.compile(r"[0-9 ().+\-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^]*")
_HOST = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)*[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.?(?::[0-9]{1,5})?\Z")
_GAP = re.compile(r"(?:\s?(?:number|no|nr|num|id)\b\.?)?[\"']?\s{0,2}(:=|=>|[:=#])?\s{0,2}[\"']?", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IDENTIFIER = re.compile(r"[A-Za-z]{0,3}[0-9](?:[ -]?[0-9]){4,18}(?![0-9A-Za-z])")
_CREDENTIAL = re.compile(r"[^\s\"'<>,;]{6,}")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    for shape in SHAPES:
        found.add_word(shape, (shape, len(shape)))
    found.make_automaton()
    return found


_built: list = []


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    if not _built:
        _built.append(_automaton())
    low, mail_end, run_end = _lowered(text), 0, 0
    for end, (kind, size) in _built[0].iter(low):
        at = end + 1 - size
        if kind == "digit":
            if at >= run_end:
                begin = at
                while begin > run_end and text[begin - 1] in _NUMERIC:
                    begin -= 1
                run_end = _NUMERIC_RUN.match(text, at).end()
                _numbers(text, begin, run_end, out)
        elif kind == "at":
            begin = at
            while begin > mail_end and text[begin - 1] in _LOCAL:
                begin -= 1
            domain = _DOMAIN.match(text, at + 1)
            if begin < at and domain:
                mail_end = domain.end()
                out["email"].append((begin, mail_end))
        elif kind == "scheme":
            _address(text, at, out)
        elif kind == "cue":
            _account(text, low, at, end + 1, out)
        else:
            m = not (at and text[at - 1].isalnum()) and _SHAPES[kind].match(text, at)
            if m and not (out["key"] and out["key"][-1][1] > at) and not text[m.end() : m.end() + 1].isalnum():
                out["key"].append(m.span())
    return out


def _numbers(text: str, begin: int, end: int, out: dict) -> None:
    for m in _IP.finditer(text, begin, end):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text, begin, end):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text, begin, end):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out["phone"].append(m.span())


def _address(text: str, at: int, out: dict) -> None:
    begin = at
    while begin and text[begin - 1] in _SCHEME and at - begin < 16:
        begin -= 1
    while begin < at and not text[begin].isalpha():
        begin += 1
    end = _ADDRESS.match(text, at + 3).end()
    body = text[at + 3 : end].rstrip(".,;:!?)]")
    authority = re.split(r"[/?#]", body, maxsplit=1)[0]
    user, _, host = authority.rpartition("@")
    personal = user or _IP.fullmatch(host.partition(":")[0])
    if begin < at and personal and _HOST.match(host) and not (out["address"] and out["address"][-1][1] > begin):
        out["address"].append((begin, at + 3 + len(body)))


def _account(text: str, low: str, begin: int, end: int, out: dict) -> None:
    if begin and low[begin - 1].isalnum() or end < len(low) and low[end].isalpha():
        return
    gap, cue = _GAP.match(text, end), low[begin:end]
    at = gap.end()
    if at == end:
        return
    if cue == "iban":
        m = _IBAN.match(text, at)
        # The longest prefix whose check digits agree: what follows may be the next word's capitals.
        size = m.end() - at if m else 0
        while size >= 15 and (text[at + size - 1] == " " or not _iban_agrees(text[at : at + size])):
            size -= 1
        found = size >= 15 and (at, at + size)
    elif cue in _SECRETS:
        m = _CREDENTIAL.match(text, at)
        # Without a sign of assignment, only passwords may be short: "token 42 of 500000" is prose.
        found = m and any(map(str.isdigit, m[0])) and (gap[1] or cue in _PASSWORDS or len(m[0]) >= 16) and m.span()
    else:
        m = _IDENTIFIER.match(text, at)
        found = m and m.span()
    if found and not (out["account"] and out["account"][-1][1] > found[0]):
        out["account"].append(found)


def _iban_agrees(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def joined(spans: dict, kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redacted(text: str | None) -> str | None:
    """The text with every span of personal data replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    spans = sorted((a, -b, k) for k, found in find_spans(text).items() for a, b in found)
    out, at, kind_at = [], 0, 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[kind_at:a], f"[{kind.upper()}]"]
        at = kind_at = max(at, -b)
    return "".join(out) + text[kind_at:]


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with personal data in the column replaced; every row and column stays."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t) if isinstance(t, str) else None)

    return docs.withColumn(column, clean(column))


def with_spans(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with column pii: an array of (kind, start, end), by kind and then start."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(texts: pd.Series) -> pd.Series:
        found = (find_spans(t if isinstance(t, str) else None) for t in texts)
        return pd.Series([[{"kind": k, "start": a, "end": b} for k in KINDS for a, b in f[k]] for f in found], dtype=object)

    return docs.withColumn("pii", spans(column))


def op1_anchor_expansion_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))



QUERIES = {"op1_anchor_expansion_pii": op1_anchor_expansion_pii}
ORACLE_SQL: dict[str, str] = {}
