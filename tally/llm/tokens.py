"""Exact, memoised encoding with a tokenizer of the tokenizers library.

Both vocabularies used here split a text before each single blank or newline that has no other white space beside it
(the byte-level one keeps the blank with the following word, the word-level one drops it), and between a letter and a
comma or full stop, so a text's ids are the ids of such chunks, one after another. A tokenizer file whose normalizer,
splitter and model settings are not one of these two encodes every text whole, slower and as exactly. Natural text repeats its words, so a table of chunks seen before saves most of the
work; it is bounded, and emptied when full. Texts with any other white space, or with the opening of a special token,
go to the tokenizer whole. Special tokens inside texts are ordinary text only if the tokenizer's own default says so:
ids equal those of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import islice

import numpy as np

from tally.llm.common import kept

assert array("I").itemsize == 4 and sys.byteorder == "little"

#: White space besides the blank and newline, in any reading of the word; the opening of a special token; and the one
#: letter whose lower case is more than letters.
ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85İ]|<\|")
#: A comma or full stop behind a plain word is a chunk of its own.
PLAIN = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,])|[.,](?=[ \n])"
KEEP_BLANK = re.compile(rf" ?{PLAIN}| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")
DROP_BLANK = re.compile(rf"{PLAIN}|[^ \n]+")
#: Chunks that can be encoded in one string and told apart again.
SIMPLE = re.compile(r"( ?)[!-~¡-ÿ]+")
#: Chunks that the word-level or the byte-level tokenizer's normalizer and splitter leave as they are: its model alone can
#: encode them, in half the time.
LOWER = re.compile(r"[a-zà-öø-ÿ]+")
LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Byte-level alphabet of the vocabularies: printable bytes stand for themselves, the others for what follows 255.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = "".join(chr(b) if b in PRINTABLE else chr(256 + b - sum(p < b for p in PRINTABLE)) for b in range(256))
# The settings of the byte-level and the word-level tokenizer whose chunks are known here.
BYTE_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_SPLIT = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
WORD_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
MAX_CHUNKS = 300_000
MAX_CHUNK_CHARS = 64
#: Texts to encode at once: what a processor's cache holds.
TEXTS = 32


def chunks_known(tok, keep_blank: bool) -> bool:
    """Whether the tokenizer is one whose chunks are known."""
    own = json.loads(tok.to_str())
    model = own["model"]
    split, form, suffix = (BYTE_SPLIT, None, None) if keep_blank else ({"type": "Sequence", "pretokenizers": WORD_SPLIT}, {"type": "Sequence", "normalizers": WORD_FORM}, "</w>")
    added = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in own["added_tokens"])
    settings = all(model.get(k) == v for k, v in MODEL.items()) and (model.get("end_of_word_suffix") or None) == suffix
    return own["pre_tokenizer"] == split and own["normalizer"] == form and own["post_processor"] is None and settings and added


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers, ready for checksums and files."""

    def __init__(self, path: str, keep_blank: bool, most: int = MAX_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if forget := getattr(self.tok.model, "_resize_cache", None):
            forget(0)  # chunks reach the model once, so a cache of its own only costs
        self.known = chunks_known(self.tok, keep_blank)
        self.keep_blank = keep_blank
        self.pattern = KEEP_BLANK if keep_blank else DROP_BLANK
        self.stale = False
        self.met = self.gaps = 0
        self.most = most
        self.seen: dict[str, bytes] = {}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token.removesuffix("</w>"))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _simple(self, chunks: list[str]) -> list[bytes]:
        """Ids of simple chunks, encoded as one text and cut where the bytes of the tokens reach the chunks' ends."""
        if not chunks:
            return []
        if self.keep_blank:
            raw = "".join(chunks).encode()
            sizes = [len(c.encode()) for c in chunks]
            ids = np.array(self.tok.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids, "<u4")
        else:
            sizes = [len(c.lower().encode()) for c in chunks]
            ids = np.array(self.tok.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        reach, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes)
        cut = np.searchsorted(reach, ends)
        if not (reach.size and cut[-1] == reach.size - 1 and (reach[np.minimum(cut, reach.size - 1)] == ends).all()):
            return self._whole(chunks)
        raw, at = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()]
        return [raw[x:y] for x, y in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """One bytes value per text."""
        if not self.known:
            return self._whole(texts)
        seen = self.seen
        if self.stale:
            seen.clear()
            self.stale = False
        parts = [self.pattern.findall(t if self.keep_blank else lower(t)) for t in texts]
        got = [list(map(seen.get, p)) for p in parts]
        gaps = [[i for i, v in enumerate(g) if v is None] if None in g else () for g in got]
        missing = {p[i] for p, own in zip(parts, gaps, strict=True) for i in own}
        found: dict[str, bytes | None] = {}
        if missing:
            blank, word = (" ", LETTERS) if self.keep_blank else ("", LOWER)
            tokenize = self.tok.model.tokenize
            for c in filter(word.fullmatch, missing):
                form = c.replace(" ", ALPHABET[32]) if c.isascii() else c.encode().decode("latin-1").translate(ALPHABET)
                found[c] = array("I", [t.id for t in tokenize(form)]).tobytes()
            simple = [c for c in missing if c not in found and (m := SIMPLE.fullmatch(c)) and m[1] == blank and "<|" not in c]
            found.update(zip(simple, self._simple(simple), strict=True))
            other = [c for c in missing if c not in found]
            plain = [c for c in other if not ODD.search(c)]
            found.update(zip(plain, self._whole(plain), strict=True))
            room = self.most - len(seen)
            seen.update(islice(((c, v) for c, v in found.items() if len(c) <= MAX_CHUNK_CHARS), max(0, room)))
            self.gaps += sum(map(len, gaps))
        self.met += sum(map(len, parts))
        if self.met > self.most:
            self.stale = len(seen) >= 0.9 * self.most and 4 * self.gaps > self.met  # another kind of text by now
            self.met = self.gaps = 0
        out = []
        for text, p, g, own in zip(texts, parts, got, gaps, strict=True):
            for i in own:
                g[i] = found.get(p[i])
            out.append(self._whole([text])[0] if own and None in g else b"".join(g))
        return out


def lower(text: str) -> str:
    """Lower case, as the word-level tokenizer gives it anyway, where that is simple: the texts of Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def encoder(path: str, keep_blank: bool, most: int = MAX_CHUNKS) -> Encoder:
    """One per Python worker, until that does other work; it remembers `most` chunks (about 200 bytes each)."""
    made, key = kept("encoders"), (path, keep_blank)
    if key not in made:
        made[key] = Encoder(path, keep_blank, most)
    return made[key]
