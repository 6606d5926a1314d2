"""Token ids of whole texts by a tokenizer file, exactly as its library gives them, with the work for repeated words done once a task.

Both JSON tokenizers cut a text by a fixed pattern before any merge and encode each piece by itself, and neither pattern has a piece
that goes on over a blank which follows one mark or letter and precedes another. So texts of plain letters, digits, ASCII marks, blanks
and line ends (nearly all) are cut there, and only words not met before go to the library; any other text goes to it whole. Which
pattern a file has is read from the file; a file with another one is always given whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Callable
from importlib.metadata import version

import numpy as np

from codelode.llm.common import when_stage_changes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes (by estimate) of words in each of two generations that a task process remembers; when one is full, the words met since are the other.
REMEMBERED = 64 << 20
#: What a remembered word takes besides its characters and ids, and the longest word that is remembered.
_ENTRY, _LONGEST = 190, 256
#: Words that are given to the library together.
_TOGETHER = 4096
#: Plain text in Latin-1: printable ASCII, tab, the line ends, and the letters from À on.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
#: White space that the byte-level pattern joins or splits by its neighbours.
_UNEVEN_BLANKS = re.compile("[\\t\\r]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\Z")
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same pattern for lower-cased plain text without blanks.
_PLAIN_WORD_PATTERN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: Marks the key of a text's first word, before which there is no blank.
_FIRST = "\0"


def digest_of_file(path: str) -> str:
    """Names a tokenizer's version: its file's SHA-256 and the library's release."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{_library(path)} {version(_library(path))}".encode()).hexdigest()


def _library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def _is_plain(text: str) -> bool:
    try:
        code = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not code.translate(None, _PLAIN) and b"<|" not in code


def _cut_with_blanks(text: str) -> list[str] | None:
    if not text or _UNEVEN_BLANKS.search(text):
        return None
    return (_FIRST + text.replace("\n", " \n")).split(" ")


def _cut_at_blanks(text: str) -> list[str]:
    return text.lower().split()


#: The characters that stand for bytes in byte-level models: printable ones for themselves, the others from U+0100 on, in order.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_AS_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def _shown(text: str) -> str:
    """A text's UTF-8 bytes as a byte-level model spells them."""
    return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(_AS_SHOWN)


def _with_blank(key: str) -> str:
    return key[1:] if key[0] == _FIRST else key if key[0] == "\n" else " " + key


def _cutter(path: str) -> tuple[Callable[[str], list[str] | None], Callable[[str], str], str] | None:
    """How texts are cut to keys, what text a key stands for, and what may stand between such texts: a piece of its own, which no key
    holds, whatever is beside it. None: not at all."""
    if _library(path) == "sentencepiece":
        return None
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    if known["post_processor"] and known["post_processor"]["type"] != "ByteLevel" or known["model"].get("dropout"):
        return None
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in known["added_tokens"]):
        return None
    before, normal = known["pre_tokenizer"] or {}, known["normalizer"]
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None:
        return _cut_with_blanks, _with_blank, "\t"
    steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
    parts = before.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _WORD_PATTERN} and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
        return _cut_at_blanks, (lambda key: key), " \x01 "
    return None


class Encoder:
    """pieces(texts): for each text what the library's result for its parts comes to, in order: their numbers of ids, or the ids as bytes."""

    def __init__(self, path: str, kind: str) -> None:
        self.remembered = REMEMBERED
        self.kind, self.of_ids, self.joined = (kind, _ids_as_bytes, b"".join) if kind == "ids" else (kind, _count, sum)
        self.known, self.before, self.size = {}, {}, 0
        self.cut, self.text_of, self.between = _cutter(path) or (None, None, None)
        if _library(path) == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.ids = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            self.tokenize = tokenizer.model.tokenize  # for single pieces: the library's normaliser and cutter would leave them as they are
        mark = self.ids([self.between])[0].ids if self.between else []
        self.mark = mark[0] if len(mark) == 1 else None
        known = [self.text_of(k) for k in ("plain", "größe", "ándale", "zq", "x")] if self.between else []
        self.bare = self.mark is not None and self._of_pieces(known) == list(map(self.of_ids, self.ids(known)))
        # in files with the word pattern any other key is cut to such pieces as well
        known = [("don't!!", ["don", "'t", "!!"]), ("é.'s_12", ["é", ".'", "s", "_", "1", "2"])]
        self.cuts_words = self.bare and self.cut is _cut_at_blanks and all(_PLAIN_WORD_PATTERN.findall(k) == x and self.joined(self._of_pieces(x)) == self.of_ids(self.ids([k])[0]) for k, x in known)

    def forget(self) -> None:
        self.known, self.before, self.size = {}, {}, 0

    def _of_pieces(self, pieces: list[str]) -> list:
        """What each piece, as the library would cut it, comes to by the library's model."""
        tokenize, of_ids = self.tokenize, self.of_ids
        return [of_ids([t.id for t in tokenize(_shown(p))]) for p in pieces]

    def _encoded(self, texts: list[str]) -> list:
        """What each text comes to; many are one text for the library, which is cut again where the mark between them is."""
        if self.mark is not None and len(texts) > 1:
            ids = np.array(self.ids([self.between.join(texts)])[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            if cut.size == len(texts) - 1:
                start, end = np.r_[0, cut + 1], np.r_[cut, ids.size]
                if self.kind == "count":
                    return (end - start).tolist()
                raw = ids.tobytes()
                return [raw[a:b] for a, b in zip((4 * start).tolist(), (4 * end).tolist(), strict=True)]
        return list(map(self.of_ids, self.ids(texts)))

    def _learn(self, keys: set[str]) -> dict:
        """Values of keys that aren't known. A letter and a comma or full stop after it are never one piece, so such words are put together from their parts."""
        if self.size > self.remembered:
            self.before, self.known, self.size = self.known, {}, 0
        known = self.known
        found = {}
        if self.before:
            again = keys & self.before.keys()
            found = dict(zip(again, map(self.before.__getitem__, again), strict=True))
            keys = keys - again
        marked = [k for k in keys if k[-1] in ",." and len(k) > 1 and k[-2].isalpha()]
        plain = keys.difference(marked)
        plain.update(k for k in [k[:-1] for k in marked] if k not in known and k not in found)
        letters = [k for k in plain if k.isalpha()] if self.bare else []
        found.update(zip(letters, self._of_pieces([self.text_of(k) for k in letters]), strict=True))
        others = list(plain.difference(letters))
        if self.cuts_words:
            cut = [_PLAIN_WORD_PATTERN.findall(k) for k in others]
            new = [p for p in {p for pieces in cut for p in pieces} if p not in known and p not in found]
            found.update(zip(new, self._of_pieces(new), strict=True))
            for k, pieces in zip(others, cut, strict=True):
                found[k] = self.joined([known[p] if p in known else found[p] for p in pieces])
        else:
            for at in range(0, len(others), _TOGETHER):
                part = others[at : at + _TOGETHER]
                found.update(zip(part, self._encoded([self.text_of(k) for k in part]), strict=True))
        if marked:
            mark = dict(zip(",.", map(self.of_ids, self.ids([",", "."])), strict=True))
            for k in marked:
                found[k] = (known[k[:-1]] if k[:-1] in known else found[k[:-1]]) + mark[k[-1]]
        kept = found if max(map(len, found)) <= _LONGEST else {k: v for k, v in found.items() if len(k) <= _LONGEST}
        known.update(kept)
        self.size += sum(map(len, kept)) + len(kept) * _ENTRY + (sum(map(len, kept.values())) if self.kind == "ids" else 0)
        return found

    def pieces(self, texts: list[str]) -> list[list]:
        out: list = []
        late, new = [], set()
        for t in texts:
            cut = self.cut(t) if self.cut is not None and _is_plain(t) else None
            if cut is None:
                out.append([self.of_ids(self.ids([t])[0])])
                continue
            values = list(map(self.known.get, cut))
            out.append(values)
            if None in values:
                holes = [i for i, v in enumerate(values) if v is None]
                missing = [cut[i] for i in holes]
                late.append((values, holes, missing))
                new.update(missing)
        if new:
            found = self._learn(new)
            for values, holes, missing in late:
                for i, v in zip(holes, map(found.__getitem__, missing), strict=True):
                    values[i] = v
        return out


def _ids_as_bytes(found) -> bytes:
    ids = getattr(found, "ids", found)
    return struct.pack(f"<{len(ids)}I", *ids)


def _count(found) -> int:
    return len(found)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The task process's own encoder, kept for its next tasks; kind: count, or ids (little-endian unsigned 32-bit integers).

    Words are remembered from one task of a stage to its next; a task of any other stage that goes through texts has them forgotten."""
    key = (path, kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, kind)
        when_stage_changes(_ENCODERS[key].forget)
    return _ENCODERS[key]


def counts(path: str, texts: list[str]) -> list[int]:
    return [sum(x) for x in encoder(path, "count").pieces(texts)]


def id_bytes(path: str, texts: list[str], remembered: int = REMEMBERED) -> list[bytes]:
    """remembered: bytes of words that the task process keeps, in two generations; fewer take longer and give the same ids."""
    own = encoder(path, "ids")
    own.remembered = remembered
    return [b"".join(x) for x in own.pieces(texts)]
