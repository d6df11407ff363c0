"""Token ids of whole texts by a tokenizer file, faster than text by text.

Every id is the one that the ``tokenizers`` library gives.  Two shortcuts are
taken only where they are known to agree with it:

* byte-level BPE: the file's own vocabulary is handed to ``tiktoken`` as ranks.
  Merging by rank of the merged bytes equals merging by pair if each
  vocabulary entry, encoded alone, is one token (a merge that tiles an entry
  has then had the same history in either); this is checked for all entries
  when the file is loaded.  Texts with characters outside a fixed Latin range,
  whose class no version of Unicode changes, or with the string of an added
  token go to the library itself.
* BPE that drops white space: a text is a sequence of pieces between spaces
  and line feeds, encoded independently: cut into words by the file's pattern,
  each merged by the file's model.  Ids of pieces and words are remembered in
  bounded tables.

Any other file: texts are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces (in Arrow) and words that a worker remembers before it starts afresh.
CACHE_PIECES, CACHE_WORDS = 200_000, 350_000
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įĲ-ňŊ-žǍ-ǯ]")
#: Pieces that a file's words and the library must agree on before words are merged alone.
_CASES = "a Word don't I'LL 'S x1y22 ¼²³ªº ÉÈ-ñ_ß ÿŸ ..,!? (a)b's' <|x|> 'd'\tq a\xa0b '' ''re ſ Ŀ"
_LOADED: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level files write for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to bytes of little-endian ids, ``width`` bytes an id."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.code = "H" if self.width == 2 else "I"
        self.table, self.met = pa.array([], pa.large_string()), np.zeros(0, dtype=bool)
        self.begin, self.pool = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=self.dtype)
        self.fast = None
        self.kind = _kind(spec)
        if self.kind == "word":
            self.letters = {b: c for c, b in _byte_letters().items()}
            self.words, self.known = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), {}
            self.merge = self._word_ranks(spec)
            texts = _CASES.split(" ")
            if self._pieces(texts) != self._whole(texts):
                self.kind = "whole"
        if self.kind == "byte":
            self.fast = self._ranks(spec)
            self.kind = "byte" if self.fast else "whole"

    def _ranks(self, spec: dict):
        """The same BPE in tiktoken, or None unless it is proved equal."""
        import tiktoken

        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        ranks = {}
        special = set(self.added)
        for word, i in vocab.items():
            if word in special:
                continue
            if any(c not in letters for c in word):
                return None
            ranks[bytes(letters[c] for c in word)] = i
            if [t.id for t in self.tok.model.tokenize(word)] != [i]:
                return None
        for i, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if vocab[a + b] != 256 + i:
                return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def pack(self, ids: Sequence[int]) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ranks(self, spec: dict):
        """The same merges of a word's bytes in tiktoken, or None unless they are proved equal.

        The byte FF, which no text has, stands for the end of a word: joined to
        the last byte it is merged before all else, as the ranks of these pairs
        are the least.
        """
        import tiktoken
        from tokenizers.models import BPE

        letters, vocab, end = _byte_letters(), spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        special, inner, ranks = set(self.added), BPE(vocab=vocab, merges=merges), {}
        for word, i in vocab.items():
            if word in special:
                continue
            stem = word.removesuffix(end) if end else word
            if not end or not stem or any(c not in letters for c in stem):
                return None
            ranks[bytes(letters[c] for c in stem) + b"\xff" * (stem != word)] = i
            if [t.id for t in (inner if stem == word else self.tok.model).tokenize(stem)] != [i]:
                return None
        first = len(ranks) - len(merges)
        if any(vocab[a + b] != first + i for i, (a, b) in enumerate(merges)) or any(ranks.get(bytes([b, 255]), first) >= first for b in range(255)):
            return None
        return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _word(self, word: str) -> bytes:
        """Ids of one word, as the model merges its bytes."""
        if self.merge:
            found = self.merge(word.encode() + b"\xff")
        else:
            letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            found = [t.id for t in self.tok.model.tokenize(letters)]
        ids = self.known[word] = array(self.code, found).tobytes()
        return ids

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without spaces: the file's pattern cuts them into words, different words are merged once.

        A piece of letters alone is one word.
        """
        find, words, word = self.words.findall, self.known, self._word
        if len(words) > CACHE_WORDS:
            words.clear()
        out: list[bytes] = []
        for p in pieces:
            low = p.lower()
            if low.isalpha():
                out.append(words.get(low) or word(low))
            else:
                out.append(b"".join([words.get(w) or word(w) for w in find(low)]))
        return out

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """The place of each piece in the table; those that it lacks are added.

        A table that is full keeps the pieces that were met again since it was last.
        """
        if len(self.table) > CACHE_PIECES:
            kept = np.flatnonzero(self.met) if 2 * self.met.sum() < CACHE_PIECES else np.zeros(0, dtype=np.int64)
            self.pool, self.begin = self._gathered(kept)
            self.table, self.met = self.table.take(pa.array(kept)), np.zeros(len(kept), dtype=bool)
        at = pc.index_in(distinct, value_set=self.table)
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        self.met[place[place >= 0]] = True
        new = distinct.filter(at.is_null())
        if len(new):
            ids = self._pieces(new.to_pylist())
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.width
            place[place < 0] = np.arange(len(self.table), len(self.table) + len(new))
            self.table, self.met = pa.concat_arrays([self.table, new]), np.append(self.met, np.zeros(len(new), dtype=bool))
            self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(size))
            self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), dtype=self.dtype))
        return place

    def _gathered(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the pieces at places of the table, one behind the other."""
        begin = self.begin[place]
        n = self.begin[place + 1] - begin
        bounds = np.append(0, np.cumsum(n))
        return self.pool[np.repeat(begin - bounds[:-1], n) + np.arange(bounds[-1])], bounds

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by their pieces: Arrow cuts, numbers and finds these; only pieces not met before are looked at one by one."""
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        ids, bounds = self._gathered(place)
        raw, at = ids.tobytes(), (bounds[cut.offsets.to_numpy()] * self.width).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as bytes; null and empty texts have none."""
        out: list[bytes] = [b""] * len(texts)
        slow: list[int] = []
        cut: list[int] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.kind == "whole" or _ODD.search(t) or any(a in t for a in self.added):
                slow.append(i)
            elif self.kind == "byte":
                out[i] = self.pack(self.fast.encode_to_numpy(t, disallowed_special=()))
            else:
                cut.append(i)
        for some, ids in ((cut, self._by_pieces), (slow, self._whole)):
            for i, x in zip(some, ids([texts[i] for i in some]) if some else [], strict=True):
                out[i] = x
        return out


def _kind(spec: dict) -> str:
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model", {})
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("byte_fallback"):
        return "whole"
    if pre.get("type") == "ByteLevel":
        plain = norm is None and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix")
        return "byte" if plain else "whole"
    steps = pre.get("pretokenizers") or []
    blank = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} for n in (norm or {}).get("normalizers", []))
    if blank and steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        if r"[^\s\p{L}\p{N}]+" in steps[0].get("pattern", {}).get("Regex", ""):
            return "word"
    return "whole"


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
