"""Word-cached encoding with the tokenizers library.

A byte-pair tokenizer treats the stretches between certain blanks independently, so
each distinct stretch is encoded once per worker and its ids are joined. Whether that holds for a
vocabulary is tried on fixed texts when it is loaded; one for which it does not encodes whole texts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import BYTE, INVERSE, mix, powers

#: Entries after which a worker's cache becomes the older of its two generations; each takes about 40 bytes an entry.
CACHE_ENTRIES = 800_000
#: Stretches longer than this many bytes are encoded but not kept.
LONGEST_KEPT = 64
#: About so many characters are gathered before the distinct stretches among them are looked up.
CHARS_AT_ONCE = 1_000_000
#: A character that either vocabulary holds as one token of its own; stretches that hold it are encoded alone.
SEPARATOR = "~"
#: Stretches that go through the library as one text.
JOINED = 200
#: Stands between the stretches of a text; texts that hold it are encoded whole.
BETWEEN = "\x1e"
#: Marks a stretch that no blank leads; texts that hold it take the careful way.
BARE = "\x1f"

_UNSAFE_SPLIT = re.compile("[\x1c-\x1f]")
_PLAIN_CASE = re.compile("[\x00-įı-ɏ]*")
#: A comma or full stop that continues a run of other signs, and so is no stretch of its own.
_IN_RUN = re.compile(r"[.,](?<=[^\w\s].|_.)")
_IN_RUN_OR_LED = re.compile(r"[.,](?<=[\W_].)")
_INNER_SPACE = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")

#: Texts on which joined stretches must give what whole texts give.
PROBES = ["a  b, c. d", " Two words. it's 12,5\n\nand  more ", "x\ty ~ z", "Él être, über: ß. ñandú", "...a,b _.c", "one\ntwo three\n", "中文 字", "Á b c", "the cat sat, on the mat. and so on\nit goes", "Hello WORLD straße élan Ñandú déjà vu naïve Ærø łódź", "supercalifragilistic unbekannteswort xqzv"]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def blank_separated(text: str) -> str:
    """Stretches, with BETWEEN between them, for a tokenizer that lower-cases and drops all white space between words."""
    if _UNSAFE_SPLIT.search(text):
        return text.replace(" ", BETWEEN)
    if _PLAIN_CASE.fullmatch(text):
        text = text.lower()
    if not _IN_RUN.search(text):
        text = text.replace(",", " ,").replace(".", " .")
    return BETWEEN.join(text.split())


def blank_led(text: str) -> str:
    """Stretches, with BETWEEN between them, for a tokenizer that glues a single blank to the word after it, by name: the blank is left out, and BARE leads what no blank leads."""
    if len(text.split()) == text.count(" ") + text.count("\n") + 1:  # single blanks and line feeds between words, nothing else
        text = text.replace("\n", " \n")
        if not _IN_RUN_OR_LED.search(text):
            text = text.replace(",", " \x1f,").replace(".", " \x1f.")
        return BARE + text.replace(" ", BETWEEN)
    return BARE + BETWEEN.join(_INNER_SPACE.split(text))


def led_text(name: str) -> str:
    """The text of a stretch that blank_led names."""
    return name[1:] if name[:1] == BARE else name if name[:1] == "\n" else " " + name


_OTHER = mix(BYTE)


def names_hashed(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each of the names (a large_string array without nulls); together they tell names apart."""
    _, offsets, data = names.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[names.offset : names.offset + len(names) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    up, down = powers(len(raw) + 1)
    size = np.diff(at).astype(np.uint64)
    out = []
    for table in (BYTE, _OTHER):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(table[raw] * up[:-1])))
        out.append(mix((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] + size * INVERSE))
    return out[0], out[1]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


_LETTERS = _byte_letters()


def letters_alone(name: str) -> str | None:
    """A stretch of letters alone as the model sees it, which no part of the library before the model would change; else None."""
    if not name.isalpha():
        return None
    return _LETTERS[32] + (name if name.isascii() else name.encode().decode("latin-1").translate(_LETTERS))


def lower_letters_alone(name: str) -> str | None:
    """The same for a tokenizer that lower-cases, normalises and drops blanks."""
    if not name.isalpha() or not _PLAIN_CASE.fullmatch(name) or name != name.lower():
        return None
    return name if name.isascii() else name.encode().decode("latin-1").translate(_LETTERS)


class Generation:
    """Ids of names by their hashes, in a few arrays."""

    def __init__(self) -> None:
        self.key, self.check = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.first, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def places(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Where each name is, or -1. Of two names with the same first hash only one is ever kept."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        first = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, flat))
        key, order = np.unique(key, return_index=True)
        at = np.searchsorted(self.key, key)
        if len(self.key):
            new = self.key[np.minimum(at, len(self.key) - 1)] != key
            key, order, at = key[new], order[new], at[new]
        for name, values in (("check", check), ("first", first), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at, values[order]))
        self.key = np.insert(self.key, at, key)


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat one after another, and where each ends (0 ahead)."""
    end = np.concatenate(([0], np.cumsum(size)))
    return flat[np.repeat(first - end[:-1], size) + np.arange(end[-1])], end


class CachedEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; equal to encoding each text at once."""

    def __init__(self, path: str, stretches) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.stretches = stretches
        self.young, self.old = Generation(), Generation()
        self.text_of = led_text if stretches is blank_led else str
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        if stretches is blank_led:
            self.marks = {" ": (" " + SEPARATOR, one(" " + SEPARATOR), 0), "\n": ("\n" + SEPARATOR, one(SEPARATOR), 1)}
        else:
            self.marks = {"": (f" {SEPARATOR} ", one(SEPARATOR), 0)}
        #: Leads whose stretches can go through the library joined: the separator is one token.
        self.marks = {lead: (glue, ids[0], before) for lead, (glue, ids, before) in self.marks.items() if len(ids) == 1}
        #: The model without what the library does before it; stretches of letters go there, which saves half of their time.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        mark = self.bare.encode(SEPARATOR, add_special_tokens=False).ids
        self.between, self.mark = f" {SEPARATOR} ", mark[0] if len(mark) == 1 else None
        self.as_model_sees = letters_alone if stretches is blank_led else lower_letters_alone
        self.apart = True
        try:
            self.apart = self(PROBES) == self._whole(PROBES)
        except ValueError:  # a separator that merged with its neighbours
            self.apart = False
        self.young = Generation()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each stretch: many go through the library as one text, with a stretch between them whose id no other one yields."""
        alone: list[str] = []
        plain: list[str] = []
        seen: list[str] = []
        sorts: dict[str, list[str]] = {lead: [] for lead in self.marks}
        for p in parts:
            if self.mark is not None and (own := self.as_model_sees(p)) is not None:
                plain.append(p)
                seen.append(own)
                continue
            text = self.text_of(p)
            lead = text[:1] if text[:1] in (" ", "\n") else ""
            word = text[1:] if lead else text
            if lead in sorts and word and word.isprintable() and SEPARATOR not in word and " " not in word:
                sorts[lead].append(p)
            else:
                alone.append(p)
        out = dict(zip(alone, self._whole([self.text_of(p) for p in alone])))
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = np.array(self.bare.encode_batch_fast([self.between.join(seen[at : at + JOINED])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark).tolist()
            raw, start = ids.tobytes(), 0
            for p, end in zip(some, [*ends, len(ids)], strict=True):
                out[p] = raw[start * 4 : end * 4]
                start = end + 1
        for lead, joined in sorts.items():
            glue, mark, before = self.marks[lead]
            for at in range(0, len(joined), JOINED):
                some = joined[at : at + JOINED]
                ids = np.array(self.tokenizer.encode(glue.join(map(self.text_of, some)), add_special_tokens=False).ids, dtype="<u4")
                marks = np.flatnonzero(ids == mark)
                raw, start = ids.tobytes(), 0
                for p, end in zip(some, [*(marks - before).tolist(), len(ids)], strict=True):
                    out[p] = raw[start * 4 : end * 4]
                    start = end + before + 1
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size > CHARS_AT_ONCE:
                out += self._join(held)
                held, size = [], 0
        return out + self._join(held) if held else out

    def _join(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if not self.apart or BETWEEN in t or not t]
        if whole:
            texts = list(texts)
            done = dict(zip(whole, self._whole([texts[i] for i in whole])))
            for i in whole:
                texts[i] = ""
        parts = pc.split_pattern(pa.array(map(self.stretches, texts), type=pa.large_string()), BETWEEN)
        coded = parts.values.dictionary_encode()
        flat, first, size = self._look_up(coded.dictionary)
        at = coded.indices.to_numpy()
        flat, end = gathered(flat, first[at], size[at])
        raw, cuts = flat.tobytes(), (end[parts.offsets.to_numpy()] * 4).tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in whole:
            out[i] = done[i]
        return out

    def _encoded(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the names."""
        names = names.to_pylist()
        found = self._encode(names)
        ids = [found[n] for n in names]
        return np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4, np.frombuffer(b"".join(ids), dtype="<u4")

    def _look_up(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of the distinct names begin among them, and how many they are."""
        short = pc.less_equal(pc.binary_length(names), LONGEST_KEPT)
        some = names.filter(short)
        key, check = names_hashed(some)
        place = self.young.places(key, check)
        gaps = np.flatnonzero(place < 0)
        if len(gaps):
            place = self.old.places(key[gaps], check[gaps])
            old = place >= 0
            if old.any():
                size = self.old.size[place[old]]
                self.young.add(key[gaps[old]], check[gaps[old]], size, gathered(self.old.flat, self.old.first[place[old]], size)[0])
            gaps = gaps[~old]
            if len(gaps):
                size, flat = self._encoded(some.take(pa.array(gaps)))
                self.young.add(key[gaps], check[gaps], size, flat)
            place = self.young.places(key, check)
        # Long names, and one of two that share their first hash, are not kept.
        apart = np.ones(len(names), dtype=bool)
        is_short = short.to_numpy(zero_copy_only=False)
        apart[is_short] = place < 0
        first, size = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        held = place[place >= 0]
        first[~apart], size[~apart] = self.young.first[held], self.young.size[held]
        flat = self.young.flat
        if apart.any():
            own, more = self._encoded(names.filter(pa.array(apart)))
            size[apart], first[apart] = own, len(flat) + np.cumsum(own) - own
            flat = np.concatenate((flat, more))
        if len(self.young.key) > CACHE_ENTRIES:
            self.young, self.old = Generation(), self.young
        return flat, first, size

    def rest(self) -> None:
        """Called at the end of a task: a worker that waits, or does other work, keeps the younger generation only."""
        self.old = Generation()


_encoders: dict[tuple, CachedEncoder] = {}


def encoder(path: str, stretches) -> CachedEncoder:
    """One encoder for each worker process."""
    key = (path, stretches.__name__)
    if key not in _encoders:
        _encoders[key] = CachedEncoder(path, stretches)
    return _encoders[key]
