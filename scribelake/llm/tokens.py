"""Token ids of whole texts with a public word-level BPE vocabulary.

The tokenizers library gives every id. In the default vocabulary white space separates pre-tokens and is dropped, so a
text's ids are the ids of its white-space separated pieces in a row; each worker keeps the pieces it has seen in a bounded
memo and asks the library only for new ones. With a vocabulary whose ids for PROBES differ when they are put together
from pieces, every text goes to the library as a whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .common import kept

DEFAULT_VOCABULARY = "word_bpe_49k.json"
MEMO_ENTRIES = 340_000  # a dict of up to 349,525 entries takes half of what the next size takes
_TAIL = ",.;:!?%&*#$|"
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Letters in both cases, marks behind, before and within words, digits, accents, several blanks, and other scripts.
PROBES = (
    "Plain words, and MORE plain words!", "it's Don't 'S ''s we'll", "...a..b,.c! 12,3.4 x-y (z) [q]; word*** w%%", "éa ÉÜÑ straße Ǆ ﬁ", " two  blanks\nand\tmore ",
    "日本語。テスト、مرحبا", "aB Cd EF ghijklmnopqrstuvwxyz0123456789",
)


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, dtype: str = "<u2") -> "PieceEncoder":
    """This worker's encoder for the vocabulary file at path."""
    return kept(("encoder", path, dtype), lambda: PieceEncoder(path, dtype))


def _plain(word: str) -> bool:
    """Lower-casing it letter by letter equals Python's, and composing it changes nothing."""
    return "İ" not in word and "Σ" not in word and unicodedata.is_normalized("NFC", word)


class PieceEncoder:
    """encode(texts) -> one bytes object of ids (dtype, little-endian) for each text."""

    def __init__(self, path: str, dtype: str = "<u2", memo_entries: int = MEMO_ENTRIES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.dtype, self.limit = dtype, memo_entries
        size = self.library.get_vocab_size()
        if size > np.iinfo(np.dtype(dtype)).max + 1:
            raise ValueError(f"{size} ids do not fit {dtype}")
        self.id_bytes = [self._bytes(i) for i in range(size)]
        self.tokenize = self.library.model.tokenize  # of one pre-token, in the byte alphabet
        self.letter = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.memo: dict[str, bytes] = {}
        self.by_pieces = True
        self.by_pieces = self.encode(PROBES) == [self._whole(t) for t in PROBES]
        self.memo.clear()

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _learn(self, piece: str) -> bytes:
        """The ids of a new piece, which go into the memo. Letters with a run of punctuation behind them are two
        pre-tokens, which are looked up apart; letters are looked up in lower case, as the vocabulary has them."""
        memo = self.memo
        core = piece if piece.isalpha() else piece.rstrip(_TAIL)
        if not core.isalpha() or not (core.isascii() or _plain(core)):
            memo[piece] = ids = self._whole(piece)
            return ids
        word = core.lower()
        ids = memo.get(word)
        if ids is None:
            mapped = word if word.isascii() else self.letter(word)[0][0]
            id_bytes = self.id_bytes
            memo[word] = ids = b"".join([id_bytes[t.id] for t in self.tokenize(mapped)])
        if len(core) < len(piece):
            tail = piece[len(core) :]
            ids += memo.get(tail) or self._learn(tail)
        if word != piece:
            memo[piece] = ids
        return ids

    def encode(self, texts) -> list[bytes]:
        out, memo, learn = [], self.memo, self._learn
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.by_pieces or any(c in text for c in _ODD_SPACE):
                out.append(self._whole(text))
            else:
                if len(memo) > self.limit:
                    memo.clear()
                pieces = text.split()
                found = list(map(memo.get, pieces))
                if None in found:
                    found = [learn(pieces[i]) if ids is None else ids for i, ids in enumerate(found)]
                out.append(b"".join(found))
        return out
