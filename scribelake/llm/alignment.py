"""Cross-tokenizer alignment (operator 12): an associative fragment monoid over byte ranges.

Tokenizer A (byte-level BPE) reads space + text, B (piece BPE, which adds the space itself) the text. Both cut the same bytes; where
an A and a B token end together, a group ends and the two are linked. A Fragment holds what a byte range knows by itself: the
tokens up to its first common end (open head), the groups between its first and last common end (closed), and the tokens
after that (open tail). Fragments of neighbouring ranges compose, and composing is associative (`compose`; EMPTY is neutral), so a
very long document is cut into ranges of CHUNK characters which different tasks align, and a tree of `FAN` fragments a node puts
them together. A document of up to CHUNK characters is one fragment and is aligned where it is read.

A range is cut anywhere, also within words: each task reads on to the nearest boundary on either side over which neither
tokenizer merges (a blank between two characters that are no blanks), and keeps the tokens that end in its range. Where
no such boundary lies within HALO characters of a cut, that cut is left out. Within a range, words between such boundaries are tokenized
once a worker while its bounded memo has them. This holds for vocabularies whose B has no piece with a blank
behind another character, and whose A splits by the byte-level pattern without normalizer; with others nothing is cut.

Pairs of ids that can be linked are few: as they end together, the bytes of one are the end of the other's. So there are no
more pairs than both vocabularies have bytes (492,481 for the two of the query), whatever the corpus; their counts are
what is broadcast.

A text that is null or empty, or whose A or B tokens joined differ from space + text, has no tokens: zeros and the digest ''. Equal rows and rows
with a null doc_id are rows of their own and count as such. Ties of counts are all best. An empty table gives an empty one.
Other columns of docs are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read_table
from .tokens import vocabulary_path

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 1 << 15
HALO = 1 << 12
FAN = 8
BATCH_CHARS = 1 << 20  # of texts given to the tokenizers at once
MEMO_ENTRIES, MEMO_CHARS = 150_000, 64  # words that a worker keeps the tokens of, and the longest of these
#: Where this is not found, every blank is a boundary over which neither tokenizer merges.
ODD_BLANKS = re.compile(r"\s\s|\A\s|\s\Z")
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_BLANK = "▁"
_workers: dict[tuple[str, str], "Aligner"] = {}


class Fragment(NamedTuple):
    """What a byte range knows. Ids are little-endian 32-bit. cut: whether it has a common end; without one all is head."""

    ok: bool
    n_a: int
    n_b: int
    cut: bool
    head_a: bytes
    head_b: bytes
    n_closed: int
    closed: str
    tail_a: bytes
    tail_b: bytes
    codes: np.ndarray
    times: np.ndarray


EMPTY = Fragment(True, 0, 0, False, b"", b"", 0, "", b"", b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
_FRAGMENT = "ok boolean, n_a long, n_b long, cut boolean, head_a binary, head_b binary, n_closed long, closed string, tail_a binary, tail_b binary, codes array<bigint>, times array<bigint>"
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, codes array<{code}>, times array<int>"


def _group(a: bytes, b: bytes) -> str:
    return ",".join(map(str, np.frombuffer(a, "<u4").tolist())) + "|" + ",".join(map(str, np.frombuffer(b, "<u4").tolist()))


def counted(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, times, len(found)).astype(np.int64)


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges, x before y."""
    ok, n_a, n_b = x.ok and y.ok, x.n_a + y.n_a, x.n_b + y.n_b
    codes, times = counted(np.concatenate([x.codes, y.codes]), np.concatenate([x.times, y.times]))
    if not x.cut:
        return Fragment(ok, n_a, n_b, y.cut, x.head_a + y.head_a, x.head_b + y.head_b, y.n_closed, y.closed, y.tail_a, y.tail_b, codes, times)
    if not y.cut:
        return Fragment(ok, n_a, n_b, True, x.head_a, x.head_b, x.n_closed, x.closed, x.tail_a + y.head_a, x.tail_b + y.head_b, codes, times)
    between = _group(x.tail_a + y.head_a, x.tail_b + y.head_b)
    closed = ";".join(c for c in (x.closed, between, y.closed) if c)
    return Fragment(ok, n_a, n_b, True, x.head_a, x.head_b, x.n_closed + 1 + y.n_closed, closed, y.tail_a, y.tail_b, codes, times)


def _letters() -> dict[str, int]:
    """The byte of each letter of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers of a worker, the bytes of their tokens, and what can be cut."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _letters()
        a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.many = len(pieces)
        # "id," or, at the end of a group, "id|" for A and "id;" for B.
        self.shown = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (self.many, ",;")) for i in range(n) for end in ends]
        self.memo: dict[str, tuple[bytes, bytes, bool]] = {}
        kept = json.loads(self.a.to_str())
        split = kept["pre_tokenizer"] or {}
        self.cuttable = kept["normalizer"] is None and (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.cuttable &= not any(_BLANK in p.lstrip(_BLANK) for p in pieces)

    def _tokens(self, words: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes, bool]]]:
        """Each word, behind a blank, with its ids of both tokenizers and whether both give its bytes."""
        for word, a, b in zip(words, self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False), self.b.encode(words, num_threads=1)):
            raw, a = (" " + word).encode(), a.ids
            ok = b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            yield word, (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes(), ok)

    def encode(self, spaced: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
        """Ids and ends of the A and B tokens of each string, which begins with a blank; whether both give its bytes.

        A string is taken apart at the boundaries over which no token goes. The words met first stay in a memo, as these are
        the frequent ones; others are tokenized once a call.
        """
        texts, memo = [s[1:] for s in spaced], self.memo
        parts = [(BOUNDARY.split(t) if ODD_BLANKS.search(t) else t.split(" ")) if self.cuttable else [t] for t in texts]
        here = dict(self._tokens(list({w: None for words in parts for w in words if w not in memo})))
        for words in parts:
            a, b, ok = zip(*[memo.get(w) or here[w] for w in words])
            a_ids, b_ids = np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.frombuffer(b"".join(b), "<u4").astype(np.int64)
            yield a_ids, np.cumsum(self.a_size[a_ids]), b_ids, np.cumsum(self.b_size[b_ids]), all(ok)
        for word, tokens in here.items():
            if len(memo) >= MEMO_ENTRIES:
                break
            if len(word) <= MEMO_CHARS:
                memo[word] = tokens

    def shared(self, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where among the A and where among the B tokens the common ends are."""
        size = int(max(a_ends[-1:].max(initial=0), b_ends[-1:].max(initial=0))) + 1
        at = np.zeros((2, size), bool)
        at[0, a_ends], at[1, b_ends] = True, True
        return np.flatnonzero(at[1, a_ends]), np.flatnonzero(at[0, b_ends])

    def render(self, a_ids: np.ndarray, b_ids: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3 of groups that end at the A tokens ia and the B tokens ib, the last of each."""
        if not len(ia):
            return ""
        ends_a, ends_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        ends_a[ia], ends_b[ib] = 1, 1
        # The group of each token; A tokens stand behind the B tokens of earlier groups, B tokens behind the A tokens of theirs.
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[np.arange(len(a_ids)) + np.concatenate([[0], ib[:-1] + 1])[group_a]] = 2 * a_ids + ends_a
        order[np.arange(len(b_ids)) + (ia + 1)[group_b]] = 2 * (len(self.a_bytes) + b_ids) + ends_b
        return "".join(map(self.shown.__getitem__, order.tolist()))[:-1]

    def fragment(self, a_ids, a_ends, b_ids, b_ends, ok: bool, lo: int, hi: int) -> Fragment:
        """Of the tokens that end behind byte lo and up to byte hi."""
        if not ok:
            return EMPTY._replace(ok=False)
        a, b = slice(*np.searchsorted(a_ends, [lo, hi], "right")), slice(*np.searchsorted(b_ends, [lo, hi], "right"))
        a_ids, a_ends, b_ids, b_ends = a_ids[a], a_ends[a], b_ids[b], b_ends[b]
        ia, ib = self.shared(a_ends, b_ends)
        raw = lambda ids: ids.astype("<u4").tobytes()
        if not len(ia):
            return EMPTY._replace(n_a=len(a_ids), n_b=len(b_ids), head_a=raw(a_ids), head_b=raw(b_ids))
        codes, times = counted(a_ids[ia] * self.many + b_ids[ib])
        (a0, a1), (b0, b1) = (ia[0] + 1, ia[-1] + 1), (ib[0] + 1, ib[-1] + 1)
        closed = self.render(a_ids[a0:a1], b_ids[b0:b1], ia[1:] - a0, ib[1:] - b0)
        return Fragment(True, len(a_ids), len(b_ids), True, raw(a_ids[:a0]), raw(b_ids[:b0]), len(ia) - 1, closed, raw(a_ids[a1:]), raw(b_ids[b1:]), codes, times)

    def _boundary(self, s: str, at: int, step: int, halo: int) -> int | None:
        """The nearest place from `at` on, in the direction of step, over which no token goes."""
        for i in range(at, at + step * halo, step):
            if i <= 0:
                return 0
            if i >= len(s):
                return len(s)
            if s[i] == " " and not s[i - 1].isspace() and i + 1 < len(s) and not s[i + 1].isspace():
                return i
        return None

    def ranges(self, text: str, chunk: int, halo: int) -> list[tuple[str, int, int]]:
        """(what to read, lo, hi) for each range of space + text: its tokens end behind byte lo and up to byte hi of that."""
        s = " " + text
        cuts = [(0, 0, 0)]  # place, boundary before, boundary behind
        for c in range(chunk, len(s), chunk) if self.cuttable else ():
            before, behind = self._boundary(s, c, -1, halo), self._boundary(s, c, 1, halo)
            if before is not None and behind is not None:
                cuts.append((c, before, behind))
        cuts.append((len(s), len(s), len(s)))
        out = []
        for (lo, begin, _), (hi, _, end) in zip(cuts, cuts[1:]):
            out.append((s[begin:end], len(s[begin:lo].encode()), len(s[begin:hi].encode())))
        return out


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _workers:
        _workers[a_path, b_path] = Aligner(a_path, b_path)
    return _workers[a_path, b_path]


def _batched(texts: list[str]) -> Iterator[slice]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    yield slice(begin, len(texts))


def _rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "codes", "times"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def _whole(doc_id, f: Fragment, keep_groups: bool) -> tuple:
    """The row of a document whose fragments are all composed: its end is a common end, so nothing is left in the tail."""
    if not f.ok or not f.cut:
        return doc_id, 0, 0, 0, "", "" if keep_groups else None, [], []
    text = _group(f.head_a, f.head_b) + (";" + f.closed if f.closed else "")
    return doc_id, f.n_a, f.n_b, 1 + f.n_closed, hashlib.sha256(text.encode()).hexdigest(), text if keep_groups else None, f.codes, f.times


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False, chunk: int = CHUNK, halo: int = HALO, fan: int = FAN) -> DataFrame:
    """A written table with doc_id, n_a, n_b, n_groups, groups_sha256, groups (or null), codes (a * B's size + b of each
    linked pair of ids) and times (how often the document links it), a row for each document."""
    import sentencepiece
    from tokenizers import Tokenizer

    sizes = Tokenizer.from_file(a_path).get_vocab_size() * sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    aligned = _ALIGNED.format(code="int" if sizes < 1 << 31 else "bigint")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        al = aligner(a_path, b_path)
        for batch in batches:
            ids, texts = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist(), batch["text"].tolist()
            for part in _batched(texts):
                out = []
                for doc_id, text, (a_ids, a_ends, b_ids, b_ends, ok) in zip(ids[part], texts[part], al.encode([" " + t for t in texts[part]])):
                    if not text or not ok:
                        out.append(_whole(doc_id, EMPTY, keep_groups))
                        continue
                    ia, ib = al.shared(a_ends, b_ends)
                    groups = al.render(a_ids, b_ids, ia, ib)
                    codes, times = counted(a_ids[ia] * al.many + b_ids[ib])
                    out.append((doc_id, len(a_ids), len(b_ids), len(ia), hashlib.sha256(groups.encode()).hexdigest(), groups if keep_groups else None, codes, times))
                yield _rows(out)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        al, key = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["text"]):
                rows = [(key, doc_id, n, *r) for n, r in enumerate(al.ranges(text, chunk, halo))]
                yield pd.DataFrame(rows, columns=["key", "doc_id", "chunk", "read", "lo", "hi"]).astype({"doc_id": "Int64"})
                key += 1

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        al = aligner(a_path, b_path)
        for batch in batches:
            for part in _batched(batch["read"].tolist()):
                rows = batch.iloc[part]
                found = [al.fragment(*tokens, lo, hi) for tokens, lo, hi in zip(al.encode(rows["read"].tolist()), rows["lo"], rows["hi"])]
                out = pd.DataFrame(found, columns=list(Fragment._fields))
                for i, name in enumerate(("key", "doc_id", "chunk")):
                    out.insert(i, name, rows[name].astype("Int64").array)
                yield out

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", ignore_index=True)
        f = EMPTY
        for r in rows[list(Fragment._fields)].itertuples(index=False):
            f = compose(f, Fragment(*r))
        out = pd.DataFrame([(rows["key"][0], rows["doc_id"].astype("Int64")[0], rows["chunk"][0] // fan, *f)], columns=["key", "doc_id", "chunk", *Fragment._fields])
        return out.astype({"doc_id": "Int64"})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
            yield _rows([_whole(i, Fragment(*r), keep_groups) for i, r in zip(ids, batch[list(Fragment._fields)].itertuples(index=False))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.char_length("text") > chunk
    short = rows.where(~long).mapInPandas(whole, aligned)
    ranges = materialize(rows.where(long).mapInPandas(split, "key long, doc_id long, chunk long, read string, lo long, hi long"), "alignment-ranges")
    last = ranges.agg(F.max("chunk")).first()[0]
    if last is None:
        out = materialize(short, "alignment")
        discard(ranges)
        return out
    keyed = "key long, doc_id long, chunk long, " + _FRAGMENT
    parts = ranges.repartition("key", "chunk").mapInPandas(fragments, keyed)
    for _ in range(math.ceil(math.log(last + 1, fan) - 1e-9) if last else 0):
        parts = parts.groupBy("key", F.floor(F.col("chunk") / fan).alias("node")).applyInPandas(together, keyed)
    out = materialize(short.unionByName(parts.mapInPandas(finish, aligned)), "alignment")
    discard(ranges)
    return out


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code, links: how many links of the corpus hold each pair of ids. No more rows than both vocabularies have bytes."""
    links = aligned.select(F.explode(F.arrays_zip("codes", "times")).alias("l"))
    return links.groupBy(F.col("l.codes").alias("code")).agg(F.sum("l.times").alias("links"))


def with_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    table = pair_counts(aligned).toArrow()
    codes, links = table["code"].to_numpy().astype(np.int64), table["links"].to_numpy()
    order = np.argsort(codes)
    codes, links = codes[order], links[order]
    highest = np.zeros(b_size, np.int64)
    np.maximum.at(highest, codes % b_size, links)
    counts = aligned.sparkSession.sparkContext.broadcast((codes, links, links == highest[codes % b_size]))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, links, best = counts.value
        for batch in batches:
            out = []
            for own, times in zip(batch["codes"], batch["times"]):
                at = np.searchsorted(known, own)
                out.append((int(times.sum()), int(times[best[at]].sum()), int((links[at] * times).sum())) if len(own) else (0, 0, 0))
            sums = pd.DataFrame(out, columns=["n_links", "n_best", "count_sum"], index=batch.index)
            frame = pd.concat([batch.drop(columns=["codes", "times"]), sums], axis=1)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]]

    rows = aligned.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times")
    return rows.mapInPandas(digest, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import sentencepiece

    b_path = vocabulary_path(B_VOCABULARY)
    aligned = align(read_table(spark, sf_dir, "documents"), vocabulary_path(A_VOCABULARY), b_path)
    return with_counts(aligned, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())


QUERIES = {"op12_fragment_alignment": op12_fragment_alignment}
ORACLE_SQL: dict[str, str] = {}
