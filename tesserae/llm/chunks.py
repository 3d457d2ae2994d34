"""Exact tokenization by distinct chunks of text, with Arrow and numpy.

A byte-level pre-tokenizer always starts a new pre-token at a blank that precedes a non-space character, and a
word-level one drops white space; so a text may be cut there, and each distinct chunk (a short run of whole
pre-tokens) needs the tokenizers library once only.  The numbers of a text are its chunks' numbers, joined.

A worker keeps the numbers of chunks from task to task, BUDGET bytes of them at most, and texts are gone through STEP
bytes at a time: what a task holds is bounded, but for a single text that is longer.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of chunks that a worker keeps, and of texts gone through at a time; a chunk of more than LONGEST bytes isn't kept for long.
BUDGET, STEP, LONGEST = 48 << 20, 3 << 20, 256
#: Bytes of strings hashed, and pre-tokens given to the library's model, at a time.
HASHED, MODELLED = 1 << 20, 1 << 15

_CUT = re.compile(r" (?=\S)")
#: A blank before white space or at the end: a text that has one isn't cut at each of its blanks.
_UNSAFE = r" ([\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
#: White space to Arrow, but not to the library.
_SEPARATORS = r"[\x1c-\x1f]"


def slices(batch, at: int, step: int | None = None):
    """Runs of rows whose texts, in column at, have `step` bytes at most, or one row each."""
    ends = np.cumsum(pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + (step or STEP), "right")))
        yield batch.slice(first, last - first)
        first = last


def strings(column: pa.StringArray) -> list[str]:
    """The same as to_pylist(), several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at starts, joined."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


#: The word-level pre-tokenizer's pattern, as its file has it.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Plain characters are those of ASCII and Latin-1's letters: no Unicode version differs in their classes, and NFC leaves them alone.
_PLAIN = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ]*")
#: The two kinds' patterns for texts of plain characters.
_PLAIN_BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+", re.ASCII)
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+", re.ASCII)
#: The byte-level alphabet: printable Latin-1 signs stand for themselves, other bytes for those from 256 on, in order.
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def _spelt(text: str) -> str:
    """text in the byte-level alphabet."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", "\u0120")  # 256 + 32
    return text.encode().decode("latin-1").translate(_ALPHABET)


_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(names: pa.StringArray) -> np.ndarray:
    """64-bit hashes of strings, HASHED bytes of them at a time: each byte takes some forty on the way."""
    ends = np.cumsum(pc.binary_length(names).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.searchsorted(ends, np.arange(HASHED, int(ends[-1]) if len(ends) else 0, HASHED), "right").tolist()
    return np.concatenate([_hashes(names.slice(a, b - a)) for a, b in itertools.pairwise([0, *cuts, len(names)])])


def _hashes(names: pa.StringArray) -> np.ndarray:
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(names) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    mixed = (data + np.uint64(1)) * (_MULTIPLIERS[place & 63] + (place >> 6).astype(np.uint64) * np.uint64(2))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    out = (sums[offsets[1:]] - sums[offsets[:-1]]) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


class Numbered:
    """Distinct strings, numbered as they come: a hash table in numpy, which unlike Arrow's stays from call to call.

    A string is found only if it is equal, whatever its hash; of two with one hash the later may be numbered again.
    """

    def __init__(self) -> None:
        self.words, self.hash, self.table = pa.array([], pa.string()), np.empty(0, np.uint64), np.full(1 << 12, -1, np.int32)

    def __len__(self) -> int:
        return len(self.words)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.hash.nbytes + self.table.nbytes

    def kept(self, numbers: np.ndarray) -> Numbered:
        """Only the strings of these ascending numbers, numbered anew in their order; nothing is hashed again."""
        out = Numbered()
        out.words, out.hash = self.words.take(pa.array(numbers)), self.hash[numbers]
        out.table = np.full(max(1 << 12, 1 << (4 * len(numbers)).bit_length()), -1, np.int32)
        out._put(0)
        return out

    def _put(self, first: int) -> None:
        """Enter the numbers from first on."""
        mask, left = len(self.table) - 1, np.arange(first, len(self.hash), dtype=np.int32)
        at = (self.hash[left] & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & mask

    def find(self, names: pa.StringArray) -> np.ndarray:
        """The numbers of names, -1 for new ones."""
        return self._find(names, hashes(names))

    def _find(self, names: pa.StringArray, own: np.ndarray) -> np.ndarray:
        out, mask, left = np.full(len(names), -1, np.int64), len(self.table) - 1, np.arange(len(names))
        at = (own & np.uint64(mask)).astype(np.int64)
        while len(left):
            met = self.table[at]
            live = met >= 0
            left, at, met = left[live], at[live], met[live]
            hit = self.hash[met] == own[left]
            out[left[hit]] = met[hit]
            left, at = left[~hit], (at[~hit] + 1) & mask
        if len(found := np.flatnonzero(out >= 0)):
            equal = pc.equal(self.words.take(pa.array(out[found])), names.take(pa.array(found))).to_numpy(zero_copy_only=False)
            out[found[~equal]] = -1
        return out

    def of(self, names: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of distinct names, and which of them are new, in the order of their numbers."""
        own = hashes(names)
        at = self._find(names, own)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self), len(self) + len(new))
            first, self.words, self.hash = len(self), pa.concat_arrays([self.words, names.take(pa.array(new))]), np.concatenate([self.hash, own[new]])
            if 2 * len(self.hash) > len(self.table):
                first, self.table = 0, np.full(1 << (4 * len(self.hash)).bit_length(), -1, np.int32)
            self._put(first)
        return at, new


class Chunks:
    """Texts as runs of numbers: subclasses tell the numbers of chunks."""

    _own: dict[tuple, Chunks] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        #: Whether white space is nothing but a cut, so that texts may be cut at any.
        self.drops = ids(" a\n, b\t") == ids("a") + ids(",") + ids("b")
        #: How texts of plain characters are cut into pre-tokens; None if the tokenizer is of neither kind.
        self.plain = _plain_cut(json.loads(self.tokenizer.to_str()))
        self.clear()

    @classmethod
    def own(cls, path: str):
        """The worker's own, with all that it has kept."""
        if (cls, path) not in cls._own:
            cls._own[cls, path] = cls(path)
        return cls._own[cls, path]

    def clear(self) -> None:
        self.keys, self.pool = Numbered(), np.empty(0, np.uint32)
        self.starts = self.sizes = self.hits = np.empty(0, np.int64)

    def _new(self, keys: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of keys, joined, and how many each has."""
        raise NotImplementedError

    def _cut(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """Distinct chunks, the place of every text's chunks among them, and where each text's end."""
        if self.drops:
            odd = pc.any(pc.match_substring_regex(texts, _SEPARATORS)).as_py()
            lists = pc.split_pattern(texts, " ") if odd else pc.utf8_split_whitespace(texts)
            chunks = lists.flatten().dictionary_encode()
            return chunks.dictionary, chunks.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        if pc.any(unsafe).as_py():
            mask = unsafe.to_numpy(zero_copy_only=False)
            safe = pc.split_pattern(texts.filter(pc.invert(unsafe)), " ")
            others = pa.array([_CUT.split(t) for t in texts.filter(unsafe).to_pylist()], pa.list_(pa.string()))
            order = np.empty(len(texts), np.int64)
            order[np.concatenate([np.flatnonzero(~mask), np.flatnonzero(mask)])] = np.arange(len(texts))
            lists = pa.concat_arrays([safe, others]).take(pa.array(order))
        else:
            lists = pc.split_pattern(texts, " ")
        offsets, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        chunks, heads = flat.dictionary_encode(), flat.take(pa.array(offsets[:-1])).dictionary_encode()
        codes = chunks.indices.to_numpy().copy()
        codes[offsets[:-1]] = len(chunks.dictionary) + heads.indices.to_numpy()  # a text's first chunk has no blank before it
        led = pc.binary_join_element_wise("", chunks.dictionary, " ")
        return pa.concat_arrays([led, heads.dictionary]), codes, offsets

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts, joined, and where each text's begin and end (one more than texts)."""
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        keys, codes, cuts = self._cut(texts)
        used = np.zeros(len(keys), bool)  # a text's first chunk is among the others too, where it may have no use
        used[codes] = True
        at = np.full(len(keys), -1, np.int64)
        keys = keys.filter(pa.array(used))
        at[used], new = self.keys.of(keys)
        if len(new):
            values, sizes = self._new(keys.take(pa.array(new)))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
            self.pool = np.concatenate([self.pool, values])
        self.hits[at[at >= 0]] += 1
        own = at[codes]
        sizes = self.sizes[own]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.pool, self.starts[own], sizes), ends[cuts]

    def _plain_keys(self, keys: list[str]) -> np.ndarray:
        """Which chunks are of plain characters, without special tokens."""
        if not self.plain:
            return np.zeros(len(keys), bool)
        ok = lambda k: (k.isascii() or _PLAIN.fullmatch(k)) and not ("<" in k and any(s in k for s in self.special))
        return np.fromiter(map(bool, map(ok, keys)), bool, len(keys))

    def pre_tokens(self, keys: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of plain chunks, joined, and how many each has.  Chunks that a blank leads are cut together, as are all of a
        word-level tokenizer: neither can run into the one before it."""
        parts: list[str] = []
        sizes = np.empty(len(keys), np.int64)
        first = next((k for k, x in enumerate(keys) if x[:1] != " "), len(keys)) if not self.drops else len(keys)
        for i in range(0, first, 16384):
            some = keys[i : min(first, i + 16384)]
            found = self.plain("".join(some) if not self.drops else " ".join(some))
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            wanted = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            at = np.searchsorted(ends, wanted)
            if len(ends) and at[-1] < len(ends) and (ends[at] == wanted).all():
                sizes[i : i + len(some)] = np.diff(at + 1, prepend=0)
                parts += found
            else:  # other white space in a chunk of a word-level tokenizer
                for k, key in enumerate(some, i):
                    parts += (own := self.plain(key))
                    sizes[k] = len(own)
        for k, key in enumerate(keys[first:], first):
            parts += (own := self.plain(key))
            sizes[k] = len(own)
        return parts, sizes

    def full(self) -> bool:
        return self.keys.nbytes + self.pool.nbytes + 24 * len(self.keys) > BUDGET  # 24: starts, sizes and hits

    def compact(self) -> None:
        """Keep what most slices have used, up to half the budget."""
        length = pc.binary_length(self.keys.words).to_numpy().astype(np.int64)
        order = np.argsort(np.where(length > LONGEST, 0, -self.hits), kind="stable")
        kept = np.sort(order[np.cumsum((length + 52 + 4 * self.sizes)[order]) <= BUDGET // 2])
        self.pool = gather(self.pool, self.starts[kept], self.sizes[kept])
        self.keys, self.sizes, self.hits = self.keys.kept(kept), self.sizes[kept], self.hits[kept] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes


def _plain_cut(own: dict):
    """The cut of a tokenizer, given its file, if it is one of the two kinds: byte-level with the usual pattern, or the word-level one."""
    kind, norm = own.get("pre_tokenizer") or {}, own.get("normalizer")
    byte = lambda k, regex: k.get("type") == "ByteLevel" and not k.get("add_prefix_space") and k.get("use_regex", True) == regex
    if not norm and byte(kind, True):
        return _PLAIN_BYTE.findall
    steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    parts = kind.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1].get("pattern") == {"Regex": r"\s+"} and len(parts) == 2 and byte(parts[1], False):
        if parts[0].get("pattern") == {"Regex": _WORD_PATTERN} and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
            return lambda text: _PLAIN_WORD.findall(text.lower())
    return None


class ChunkEncoder(Chunks):
    """The numbers are token ids: the library's model makes them of each distinct pre-token of plain characters, its whole pipeline of other chunks."""

    def run(self, texts):
        if self.full():
            self.compact()
        return super().run(texts)

    def __init__(self, path: str) -> None:
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers

        #: The model alone, on spelt pre-tokens between blanks; and how many signs of the alphabet each id stands for.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        own = self.bare.get_vocab(with_added_tokens=False)
        self.signs = np.zeros(max(own.values(), default=0) + 1, np.int64)
        end = len(getattr(self.tokenizer.model, "end_of_word_suffix", None) or "")
        for token, k in own.items():
            self.signs[k] = len(token) - end * (end > 0 and token.endswith(self.tokenizer.model.end_of_word_suffix))

    def _new(self, keys):
        own = strings(keys)
        plain = self._plain_keys(own)
        parts, n = self.pre_tokens([k for k, ok in zip(own, plain) if ok])
        names = pa.array(parts, pa.string()).dictionary_encode()
        ids, lengths = self._model([_spelt(t) for t in strings(names.dictionary)])
        codes = names.indices.to_numpy()
        each, sizes = lengths[codes], np.zeros(len(own), np.int64)
        sizes[plain] = np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(n)])])
        found = gather(ids, (np.cumsum(lengths) - lengths)[codes], each)
        if plain.all():
            return found, sizes
        others = [k for k, ok in zip(own, plain) if not ok]
        rest = [x.ids for i in range(0, len(others), 4096) for x in self.tokenizer.encode_batch_fast(others[i : i + 4096], add_special_tokens=False)]
        sizes[~plain] = list(map(len, rest))
        out, mine = np.empty(int(sizes.sum()), np.uint32), np.repeat(plain, sizes)
        out[mine], out[~mine] = found, np.fromiter(itertools.chain.from_iterable(rest), np.uint32)
        return out, sizes

    def _model(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, joined, and how many each has, by the library's model, MODELLED at a time: its results are large."""
        found = [self._some(names[i : i + MODELLED]) for i in range(0, len(names), MODELLED)] or [self._some([])]
        return np.concatenate([ids for ids, _ in found]), np.concatenate([sizes for _, sizes in found])

    def _some(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Those of some pre-tokens, told apart by the signs their ids stand for."""
        found = [x.ids for x in self.bare.encode_batch_fast([" ".join(names[i : i + 256]) for i in range(0, len(names), 256)], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
        ends, wanted = np.cumsum(self.signs[ids]), np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
        at = np.searchsorted(ends, wanted)
        if len(names) and (at[-1] != len(ids) - 1 or (ends[at] != wanted).any()):  # an unknown sign, or none at all
            found = [[x.id for x in self.tokenizer.model.tokenize(t)] for t in names]
            return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        return ids, np.diff(at + 1, prepend=0)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        ids, ends = self.run(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in itertools.pairwise(ends)]


class PreTokens(Chunks):
    """The numbers are places among words, the pre-tokens that the worker has met since clear(), which is left to the caller."""

    def clear(self) -> None:
        super().clear()
        self.numbered = Numbered()

    @property
    def words(self) -> pa.StringArray:
        return self.numbered.words

    def _new(self, keys):
        own = strings(keys)
        plain = self._plain_keys(own) & (not self.drops)
        parts, n = self.pre_tokens([k for k, ok in zip(own, plain) if ok])
        # A special token, or another kind of tokenizer: the chunk is counted whole.
        whole = lambda k: self.drops or self.plain is None or "<" in k and any(s in k for s in self.special)
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer else None
        rest = [[k] if whole(k) else [k[a:b] for _, (a, b) in cut(k)] for k, ok in zip(own, plain) if not ok]
        sizes = np.empty(len(own), np.int64)
        sizes[plain], sizes[~plain] = n, list(map(len, rest))
        if rest:
            some, others = iter(parts), itertools.chain.from_iterable(rest)
            parts = [next(some if ok else others) for ok in np.repeat(plain, sizes).tolist()]
        names = pa.array(parts, pa.string()).dictionary_encode()
        return self.numbered.of(names.dictionary)[0][names.indices.to_numpy()].astype(np.uint32), sizes

    def full(self) -> bool:
        return super().full() or self.numbered.nbytes > BUDGET

    def pieces(self, names: pa.StringArray) -> np.ndarray:
        """How many tokens the library makes of each."""
        out = []
        for i in range(0, len(names), 4096):
            out += map(len, self.tokenizer.encode_batch_fast(strings(names[i : i + 4096]), add_special_tokens=False))
        return np.array(out, np.int32)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
