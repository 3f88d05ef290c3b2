"""Ids of whole texts by a public tokenizer file, a unit between spaces at a time.

Tokenizers of two shapes are cut at spaces where their own pre-tokenisation always cuts, and each distinct unit
is encoded once a worker by the library's own model; any other tokenizer encodes whole texts by the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache
from os.path import commonprefix
from string import punctuation

#: Units remembered by a worker; later ones are encoded each time. Frequent units come early.
MEMO = 300_000
DOOR = 1 << 22  #: places for the hashes of units that came once
PIECES = 100_000  #: pre-tokens remembered
_MARKS = punctuation.replace("'", "")  #: a run of these behind a word is one pre-token; an apostrophe may begin another kind
LONG = 64  #: characters of a unit that isn't remembered


def unsure(text: str) -> bool:
    """Whether a character is unassigned here: patterns' engines of other Unicode versions may take it for a letter."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


def _latin(text: str) -> bool:
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class _Memo(dict):
    """Remembers what comes a second time: most distinct units come once."""

    def __init__(self, make, most: int = MEMO):
        self.make, self.most, self.came = make, most, bytearray(DOOR)

    def __missing__(self, unit):
        made = self.make(unit)
        if len(self) < self.most and len(unit) <= LONG:
            at = hash(unit) % DOOR
            if self.came[at]:
                self[unit] = made
            else:
                self.came[at] = 1
        return made


def _byte_letters() -> list[str]:
    """The printable letter for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def merger(model: dict):
    """A function from a pre-token's bytes to its packed ids, by tiktoken's merge loop; None if it could differ.

    That loop joins two neighbours whenever their bytes together are a token, a merge list only the pair that it
    names. They agree where each merge makes a token of its own from older ones and each token, on its own,
    merges to itself: a token's bytes between two boundaries then evolve as they do alone. An end-of-word
    suffix becomes byte 255, which UTF-8 never holds, joined to the last byte before anything else.
    """
    import tiktoken

    value = {c: b for b, c in enumerate(_byte_letters())}
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    raw = lambda t: bytes(map(value.__getitem__, t[: -len(end)])) + b"\xff" if end and t.endswith(end) else bytes(map(value.__getitem__, t))
    order: dict[bytes, int] = {}
    ids: list[int] = []
    letters = list(value)
    for t in [c + end for c in letters] * bool(end) + [m if isinstance(m, str) else "".join(m) for m in (x.replace(" ", "") if isinstance(x, str) else x for x in model["merges"])]:
        if t not in vocab or raw(t) in order:
            return None
        order[raw(t)] = len(ids)
        ids.append(vocab[t])
    made = set(order)
    for t in letters:
        if t not in vocab:
            return None
        order[raw(t)] = len(ids)
        ids.append(vocab[t])
    if end and bytes([255]) not in order:
        return None
    core = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=order, special_tokens={})._core_bpe
    if any(core.encode_single_piece(t) != [order[t]] for t in made):
        return None
    mark = b"\xff" if end else b""
    one, four = core.encode_single_piece, [i.to_bytes(4, "little") for i in ids].__getitem__
    return lambda piece: b"".join(map(four, one(piece + mark)))


class Ids:
    """``packed(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.path = path
        before, normal = told["pre_tokenizer"] or {}, told["normalizer"]
        letters = str.maketrans({b: c for b, c in enumerate(_byte_letters())})
        marks = [t["content"] for t in told["added_tokens"]]
        lead = commonprefix(marks)

        merged = merger(told["model"]) if told["model"]["type"] == "BPE" else None

        def modelled(p: bytes) -> bytes:
            return array("I", [t.id for t in self.library.model.tokenize(p.decode("latin-1").translate(letters))]).tobytes()

        self.merged = merged or modelled
        self.pieces = _Memo(lambda p: self.merged(p.encode()), PIECES)
        steps = before.get("pretokenizers", [])
        if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and told["model"]["type"] == "BPE":
            self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
            self.packed = self._spaced
        elif (
            normal and [n["type"] for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"] and r"\s" in steps[0]["pattern"]["Regex"]
        ):
            self.find, normalised = regex.compile(steps[0]["pattern"]["Regex"]).findall, lambda u: self.library.normalizer.normalize_str(u)

            def unit(u: str) -> bytes:
                if lead in u and any(m in u for m in marks):
                    return self._whole(u)
                # below U+0100 NFC changes nothing and lower() goes letter by letter as the library does
                if u.isascii() or _latin(u):
                    return self._joined(u.lower()) if u else b""
                return self._whole(u) if unsure(u) else b"".join([self.pieces[p] for p in self.find(normalised(u))])

            self.units = _Memo(unit)
            self.packed = self._blank
        else:
            self.packed = self._whole
        self.after = _Memo(self._after)

    @cached_property
    def library(self):
        """The library's tokenizer, loaded where a text needs it: it has as many bytes as all else that a worker holds of the file."""
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(self.path)
        held.encode_special_tokens = True
        return held

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _joined(self, unit: str) -> bytes:
        """The ids of a unit's pre-tokens; of a word, and of a word and a run of marks, without the pattern."""
        stem = unit.rstrip(_MARKS)
        if (stem[1:] if stem[:1] == " " else stem).isalpha():
            return self.merged(stem.encode()) + self.pieces[unit[len(stem) :]] if len(stem) < len(unit) else self.merged(unit.encode())
        return self._cut(unit)

    def _cut(self, unit: str) -> bytes:
        return self._whole(unit) if unsure(unit) else b"".join([self.pieces[p] for p in self.find(unit)])

    def _blank(self, text: str) -> bytes:
        """White space separates and goes."""
        return b"".join(map(self.units.__getitem__, text.replace("\n", " ").split(" ")))

    def _after(self, unit: str) -> bytes | None:
        """Of a unit behind a space; None where the space stands beside other white space."""
        if not unit or unit[0].isspace() or unit[-1].isspace():
            return None
        return self._joined(" " + unit)

    def _spaced(self, text: str) -> bytes:
        """A pre-token starts at each single space between two characters that aren't white space."""
        first, *rest = text.split(" ")
        try:
            if not first or not first[-1].isspace():
                return b"".join([self._cut(first), *map(self.after.__getitem__, rest)]) if first or not rest else self._careful(text)
        except TypeError:
            pass
        return self._careful(text)

    def _careful(self, text: str) -> bytes:
        first, *rest = re.split(r"(?<=\S) (?=\S)", text)
        return b"".join([self._cut(first), *(self._cut(" " + u) for u in rest)])


@lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    """One a worker and file."""
    return Ids(path)


@lru_cache(maxsize=4)
def largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)
