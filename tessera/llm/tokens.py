"""Token ids of whole texts with public tokenizer files, with a bounded cache of repeated pieces."""

from __future__ import annotations

import array
import functools
import gc
import hashlib
import json
import os
import re
import sys

from . import common

#: A plain space before a non-space starts a new pre-token of byte-level BPE, whatever stands before it.
_CUT = re.compile(r" (?=\S)")
#: A space-led word of Latin letters is one pre-token, and marks after it are another. The marks leave out <, | and >, of which special tokens are made.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,!?;:*%&$#]*)")
#: Characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _pack(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def version_digest(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    return hashlib.sha256(open(path, "rb").read() + version.encode()).hexdigest()


_SECTION = 1 << 20


def _sections(text: str, most: int = _SECTION):
    """The text in parts that begin where a pre-token begins, each a little over ``most`` long."""
    at = 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Encoder:
    """Ids by the library of the file; for plain byte-level BPE, ids of each space-led piece are kept for reuse.

    Cutting there cannot change ids: no pre-token of the pattern runs over such
    a place, there is no normaliser, and no added token holds a space. A missing
    piece that is a plain word and marks is put together from the two, the word
    by the library's model alone as it is one pre-token. Any other file is
    encoded text by text. Beyond ``most`` pieces, those not
    used since half as many came are forgotten.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = path.endswith(".model")
        if self.model:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_piece = False
            return
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and spec.get("normalizer") is None
            and spec["model"].get("type") == "BPE"
            and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback"))
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        )
        self.pieces, self.sizes = _Pieces(self.lib, _pack, most), _Pieces(self.lib, len, most)

    def raw(self, texts: list[str]) -> list[list[int]]:
        if self.model:
            return [list(x) for x in self.lib.encode(texts, num_threads=1)]
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, text: str, pieces: dict, total):
        """``total`` of the values of a text's pieces."""
        get = pieces.__getitem__
        if len(text) <= _SECTION:
            p = text.split(" ")
            p[0] = " " + p[0]
            try:
                return total(map(get, p))
            except _NotAPiece:  # white space after a space: the pattern cuts elsewhere
                pass
        out = None
        for k, section in enumerate(_sections(text)):
            p = _CUT.split(section)
            if k:
                del p[0]  # empty: the section begins with the space of its first piece
            else:
                p[0] = " " + p[0]  # a text's own start; other pieces never begin with a space
            v = total(map(get, p))
            out = v if out is None else out + v
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return [len(x) for t in texts for x in self.raw([t])]
        return [self._known(t, self.sizes, sum) for t in texts]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_piece:
            return [_pack(x) for t in texts for x in self.raw([t])]
        return [self._known(t, self.pieces, b"".join) for t in texts]


class _NotAPiece(KeyError):
    """A text was cut before a space that white space follows."""


class _Pieces(dict):
    """Values (id bytes or counts) of pieces, made when asked for; those unused since half of ``most`` others came are forgotten."""

    def __init__(self, lib, value, most: int):
        super().__init__()
        self.lib, self.value, self.most, self.older = lib, value, most, {}
        self.tokenize = lib.model.tokenize
        self.marks: dict[str, object] = {"": value([])}

    def _word(self, w: str):
        if w.isascii():
            w = w.replace(" ", "\u0120")
        else:
            w = w.encode().decode("latin-1").translate(_BYTE_CHARS)
        return self.value([t.id for t in self.tokenize(w)])

    def _marks(self, mark: str):
        if mark not in self.marks:
            if len(self.marks) > 20_000:
                self.marks = {"": self.marks[""]}
            self.marks[mark] = self.value(self.lib.encode(mark, add_special_tokens=False).ids)
        return self.marks[mark]

    def _plain(self, piece: str):
        """The value of words and marks, if the piece is nothing else; lines after the first begin without a space."""
        out = None
        for k, line in enumerate(piece.split("\n") if "\n" in piece else (piece,)):
            m = _WORD.fullmatch(line)
            if m is None:
                return None
            word, mark = m.groups()
            if k == 0:
                out = self.get(word) if mark else None
                out = self._word(" " + word) if out is None else out
            else:
                out = out + self._marks("\n") + self._word(word)
            if mark:
                out = out + self._marks(mark)
        return out

    def __missing__(self, piece: str):
        first = piece[:1]
        if first != " " and (not first or first.isspace()):
            raise _NotAPiece(piece)
        v = self.older.get(piece)
        if v is None:
            v = self._plain(piece)
        if v is None:
            v = self.value(self.lib.encode(piece[1:] if piece[:1] == " " else " " + piece, add_special_tokens=False).ids)
        if len(piece) > 200:
            return v  # too long to be worth keeping
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = v
        return v


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    gc.set_threshold(200_000, 20, 20)  # millions of short strings, and no cycles
    return Encoder(path)


common.register_cache("tokens", _encoder.cache_clear)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    common.use_caches("tokens")
    return _encoder(path)
