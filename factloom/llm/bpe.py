"""Exact byte-pair encoding of whole texts by public vocabularies.

Texts are cut where no pre-token can cross (before a run of white space), so that a cut's ids depend on the cut alone;
each worker remembers the ids of the cuts it has met, in tables of bounded bytes. What the byte-level encoders need to
know of the tokenizers library (which vocabulary strings are whole tokens, and where its character classes differ from
ours) is proved once on the driver and sent to the workers, which do not use the library.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

#: Bytes that a worker remembers in each of its tables; a full table starts anew.
MEMORY = 64 << 20
#: Characters of a cut or pre-token that is remembered, at most.
LONGEST = 512

#: White space of the public pattern besides the space itself (fixed values).
_ODD_SPACES = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile("[\x03-\u024f]*")
_BORDERED = re.compile("[\x02-\u024f]*")
_JOINED_SPACE = re.compile(f" [ {_ODD_SPACES}]|[{_ODD_SPACES}] |^ | $")
_CUTS = re.compile(f"[ {_ODD_SPACES}]*[^ {_ODD_SPACES}]+|[ {_ODD_SPACES}]+")


def _byte_alphabet() -> dict[str, int]:
    """The public rule of byte-level vocabularies: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo(dict):
    """A dict of bounded bytes that computes what it lacks; long keys are computed each time."""

    def __init__(self, make, limit: int | None = None):
        super().__init__()
        self.make, self.limit, self.held = make, MEMORY if limit is None else limit, 0

    def __missing__(self, key):
        out = self.make(key)
        if isinstance(key, int) or len(key) <= LONGEST:
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self.held += sys.getsizeof(key) + sys.getsizeof(out) + 64
            self[key] = out
        return out


def _library(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordBpe:
    """Ids by a lower-casing vocabulary whose merges end in a word-end mark (word_bpe_49k.json)."""

    _PIECES = regex.compile(r"\x02|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}\x02]+")

    def __init__(self, path: str):
        self.library = _library(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        byte, end = _byte_alphabet(), model["end_of_word_suffix"]
        own = {}
        for s, i in model["vocab"].items():
            closed = s.endswith(end)
            own[bytes(byte[c] for c in (s[: -len(end)] if closed else s)) + b"\x01" * closed] = i
        # The word end is a byte that pieces on this path cannot hold; ids follow the order of merges.
        self.merge = tiktoken.Encoding("word", pat_str=r"[^\x01]*\x01", mergeable_ranks=own, special_tokens={})
        self.border = self.merge.encode_ordinary("\x02\x01")[0]
        self.lower = self.library.normalizer.normalize_str
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, cuts: list[str]) -> None:
        """Adds the cuts' ids to what is known: one pass of the pattern and of the merges over all, with marks between cuts."""
        plain = [c for c in cuts if "<|" not in c and _PLAIN.fullmatch(c)]
        low = "\x02".join(plain)
        low = low.lower() if low.isascii() else self.lower(low)
        if not _BORDERED.fullmatch(low) or low.count("\x02") != len(plain) - 1:  # lower case may leave the blocks
            plain = []
        if plain:
            ids = self.merge.encode_to_numpy("\x01".join(self._PIECES.findall(low)) + "\x01")
            ends = np.append(np.flatnonzero(ids == self.border), len(ids))
            at, ids = np.concatenate([[0], ends[:-1] + 1]) * 4, ids.astype("<u4").tobytes()
            self.known.update(zip(plain, [ids[a:b] for a, b in zip(at.tolist(), (ends * 4).tolist(), strict=True)], strict=True))
        self.known.update((c, self._library_ids(c)) for c in cuts if c not in self.known)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        cuts = [None if _ODD_SPACE.search(t) else t.split() for t in texts]
        met = set(chain.from_iterable(c for c in cuts if c))
        if new := met.difference(self.known):
            if self.held > MEMORY:
                self.known.clear()
                self.held, new = 0, met
            self._learn(list(new))
            self.held += sum(sys.getsizeof(c) + len(self.known[c]) + 97 for c in new)
        get = self.known.__getitem__
        return [self._library_ids(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cuts, strict=True)]


class Proof(NamedTuple):
    """What is known of a byte-level vocabulary's library form: strings that it encodes as one token, and the characters
    that its tables class otherwise than ours, by the class it gives them (letter, number, space, other), as ranges."""

    whole: frozenset[str]
    moved: tuple[tuple[str, str], ...]


_CLASSES = {"letter": regex.compile(r"\p{L}+"), "number": regex.compile(r"\p{N}+"), "space": regex.compile(r"\s+"), "other": regex.compile(r"[^\s\p{L}\p{N}]+")}


def _moved(split) -> tuple[tuple[str, str], ...]:
    """For all code points: (class of the library, ranges as in a character set) where it is not our own class.

    split(text) gives the library's pre-tokens. All characters of one class of ours make one text; wherever the library
    cuts it, its classes change, and one character of each part tells which class it is.
    """
    out: dict[str, str] = {}
    whole = "".join(map(chr, chain(range(0x21, 0xD800), range(0xE000, 0x110000))))
    for own, chars in _CLASSES.items():
        if own == "space":
            continue
        for part in split("".join(chars.findall(whole))):
            kind = next((k for k, with_ in (("letter", "a"), ("number", "1"), ("other", "!")) if len(split(with_ + part[0])) == 1), "space")
            if kind != own:
                codes = np.array([ord(c) for c in part])
                edge = np.flatnonzero(np.diff(codes) != 1)
                low, high = codes[np.append(0, edge + 1)], codes[np.append(edge, len(codes) - 1)]
                out[kind] = out.get(kind, "") + "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in zip(low.tolist(), high.tolist(), strict=True))
    return tuple(sorted(out.items()))


@lru_cache(maxsize=4)
def prove(path: str) -> Proof:
    """Asks the tokenizers library, once: every vocabulary string that is text and one pre-token, and every code point."""
    library = _library(path)

    def split(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]

    moved = _moved(split)
    own = ByteBpe(path, Proof(frozenset(), moved))
    texts = {}
    for i, b in own.token_bytes.items():
        try:
            texts[b.decode()] = i
        except UnicodeDecodeError:
            continue
    names = [s for s in texts if own.pieces(s) == [s]]
    got = library.encode_batch(names, add_special_tokens=False)
    return Proof(frozenset(s for s, e in zip(names, got, strict=True) if e.ids == [texts[s]]), moved)


class ByteBpe:
    """What op6 and op8 share: the cuts of a byte-level vocabulary (byte_bpe_50k.json), its special strings and its pre-tokens."""

    _PIECES = regex.compile(public_tokenizers.PATTERN)

    def __init__(self, path: str, proof: Proof):
        model = json.load(open(path, encoding="utf-8"))
        byte, self.vocab = _byte_alphabet(), model["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        if model["normalizer"] or any(x["lstrip"] or x["rstrip"] or x["single_word"] or _CUTS.findall(x["content"]) != [x["content"]] for x in model["added_tokens"]):
            raise ValueError(f"{path} has a normaliser or special strings that reach over white space")
        #: What every special string starts with.
        self.lead = os.path.commonprefix(list(self.special))
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.token_bytes = {i: bytes(byte[c] for c in s) for s, i in self.vocab.items() if s not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        ranges = dict(proof.moved)
        every = "".join(ranges.values())
        self.moved = regex.compile(f"[{every}]" if every else r"(?!)")
        self.moved_ascii = bool(self.moved.search("".join(map(chr, range(128)))))
        sets = {k: f"[[{own}--[{every}]]||[{ranges[k]}]]" if k in ranges else f"[{own}--[{every}]]" for k, own in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s"), ("other", r"[^\s\p{L}\p{N}]"))} if every else {}
        pattern = public_tokenizers.PATTERN
        if every:
            # The same pattern, with the classes spelt out.
            space = sets["space"]
            pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{sets['letter']}+| ?{sets['number']}+| ?{sets['other']}+|{space}+(?=$|{space})|{space}+"
        self.moved_pieces = regex.compile("(?V1)" + pattern)

    def cuts(self, text: str, first, inner):
        """Values of a text's cuts: first(cut with its white space), inner(what follows one space)."""
        if _JOINED_SPACE.search(text):
            return map(first, _CUTS.findall(text))
        head, *rest = text.split(" ")
        return [first(head), *map(inner, rest)] if head else map(inner, rest)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        odd = self.moved_ascii if text.isascii() else True
        return (self.moved_pieces if odd and self.moved.search(text) else self._PIECES).findall(text)

    def parts(self, cut: str) -> list[str | int]:
        """A cut's pre-tokens as texts, and its special strings as ids, in order."""
        if self.lead not in cut:
            return self.pieces(cut)
        out, at = [], 0
        for m in self.specials.finditer(cut):
            out += self.pieces(cut[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.pieces(cut[at:])


class WholeTokenCounter(ByteBpe):
    """Counts tokens. Strings proved to encode alone as one token count as one; only the rest is merged."""

    def __init__(self, path: str, proof: Proof):
        super().__init__(path, proof)
        self.whole = proof.whole
        own = {b: i for i, b in self.token_bytes.items()}
        self.merge = tiktoken.Encoding("byte", pat_str=r"(?s:.+)", mergeable_ranks=own, special_tokens={}).encode_ordinary
        self.first = Memo(self._cut).__getitem__
        self.inner = Memo(lambda rest: self._cut(" " + rest)).__getitem__

    def _cut(self, cut: str) -> int:
        return sum(1 if isinstance(p, int) or p in self.whole else len(self.merge(p)) for p in self.parts(cut))

    def count(self, text: str) -> int:
        return sum(self.cuts(text, self.first, self.inner))


class BacktrackingBpe(ByteBpe):
    """Encodes by longest matches that a pair table accepts, stepping back where none fits; decodes by an offset table.

    An Aho-Corasick pass finds the longest token from each position of a pre-token. A token may follow another if
    merging would have kept the border between them (compatible()); else the next shorter prefix token is tried, and if
    none is left the last token is given up. Each position is given up once at most, so the time is linear.
    """

    def __init__(self, path: str, proof: Proof):
        super().__init__(path, proof)
        n = max(max(self.vocab.values()), *self.special.values()) + 1
        self.length = [0] * n
        self.left, self.right, self.joined = list(range(n)), list(range(n)), {}
        for a, b, ab in self.merges:
            self.left[ab], self.right[ab], self.joined[a, b] = a, b, ab
        self.automaton = ahocorasick.Automaton()
        by_bytes = {b: i for i, b in self.token_bytes.items()}
        self.shorter = [-1] * n
        for b, i in by_bytes.items():
            self.length[i] = len(b)
            self.automaton.add_word(b.decode("latin-1"), (len(b) - 1, i))
            self.shorter[i] = next((by_bytes[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in by_bytes), -1)
        self.automaton.make_automaton()
        self.fits = Memo(self._compatible)
        self.piece_ids = Memo(self._piece)
        self.first = Memo(self._cut).__getitem__
        self.inner = Memo(lambda rest: self._cut(" " + rest)).__getitem__
        blobs = [self.token_bytes.get(i, b"") for i in range(n)]
        for s, i in self.special.items():
            blobs[i] = s.encode()
        self.bytes_table = self._offset_table(blobs)
        self.decimal_table = self._offset_table([b"%d," % i for i in range(n)])

    def _compatible(self, pair: int) -> bool:
        """Whether merging both tokens' bytes keeps the border: undo merges from the later one and look for an earlier merge across."""
        a, b = pair >> 20, pair & 0xFFFFF
        limit = len(self.length) + 1
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            undo_a = a > b
            for _ in range(2):
                if undo_a:
                    limit, a, whole = a, self.right[a], a
                    if a != whole:
                        break
                else:
                    limit, b, whole = b + 1, self.left[b], b
                    if b != whole:
                        break
                undo_a = not undo_a
            else:
                return True

    def _piece(self, piece: bytes) -> bytes:
        n, best = len(piece), [0] * len(piece)
        for end, (before, token) in self.automaton.iter(piece.decode("latin-1")):
            best[end - before] = token  # of tokens from one position the longest ends last
        length, shorter, fits = self.length, self.shorter, self.fits
        out, dead = [], set()
        at, token = 0, best[0] if n else 0
        while at < n:
            if out:
                last = out[-1] << 20
                while token >= 0 and (not fits[last | token] or at + length[token] in dead):
                    token = shorter[token]
            elif dead:
                while token >= 0 and at + length[token] in dead:
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at < n:
                    token = best[at]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
        return array("I", out).tobytes()

    def _cut(self, cut: str) -> bytes:
        return b"".join([p.to_bytes(4, "little") if isinstance(p, int) else self.piece_ids[p.encode()] for p in self.parts(cut)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.cuts(text, self.first, self.inner)), dtype="<u4")

    @staticmethod
    def _offset_table(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])])

    @staticmethod
    def _gather(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
        blob, offs = table
        starts = offs[ids]
        sizes = offs[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return blob[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; bytes that are no text become U+FFFD, as in the library."""
        return self._gather(self.bytes_table, ids).decode("utf-8", "replace").encode()

    def decimal(self, ids: np.ndarray) -> bytes:
        """Ids in decimal, joined by commas."""
        return self._gather(self.decimal_table, ids)[:-1]


_encoders: dict = {}


def encoder(kind: type, path: str, *proof: Proof):
    """One encoder a worker and path."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path, *proof)
    return _encoders[kind, path]
