"""Subword ids of whole texts by a public tokenizer, through a cache of words.

The tokenizer drops white space and never looks across it, so a text's ids are those of its words one after the other;
each distinct word is tokenised once in a worker. The cache is bounded and starts anew when full.

Words of common Latin letters, digits and ASCII signs are cut into pre-tokens here, by the rules that the tokenizer's
file states, and only these go to its model; all other words, and tokenizers with other rules, take its whole way.
``ids_of_spans`` does the same for many words at once in numpy, merges of pairs included, without a cache.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

#: Words and pre-tokens kept, at some 200 bytes each.
CACHE_WORDS, CACHE_PIECES = 400_000, 200_000
#: Bytes of words and ids kept.
CACHE_BYTES = 64 << 20
BATCH = 4096
# The rules of the tokenizer file that the short way follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The letter that stands for each byte: itself where it is printable, else one from 256 on.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
LETTERS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(SHOWN))}

#: Bytes of the pre-tokens that are merged together, by group; longer ones go to the tokenizer's model.
TOGETHER = (1, 4, 6, 8, 10, 13, 16, 24)
#: Pre-tokens merged together at most; this bounds temporary arrays.
AT_ONCE = 1 << 16
# Bits of a place in a pre-token, and what is above every rank and place.
PLACE, NONE = 5, np.int32(1 << 30)
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(0x80, 0x100)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


class Merges:
    """The merges of a byte-level BPE model over many pre-tokens at once: in each the pair of lowest rank, the leftmost
    of equal ones, again and again, as the model does."""

    @staticmethod
    def follows(model: dict) -> bool:
        """Whether the model has the rules that are followed here."""
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        suffix, vocab = model.get("end_of_word_suffix") or "", model.get("vocab", {})
        return plain and all(x in vocab and x + suffix in vocab for x in LETTERS.values()) and max(vocab.values()) < 1 << 16

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner, self.last = (np.array([vocab[LETTERS[b] + x] for b in range(256)], np.int32) for x in ("", suffix))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = self.key(*(np.array([vocab[m[i]] for m in pairs], np.int32) for i in (0, 1)))
        # an open table; of a pair that is listed twice the last one counts
        key, at = np.unique(key[::-1], return_index=True)
        rank = (len(pairs) - 1 - at).astype(np.int32)
        self.bits = max(8, int(4 * len(key)).bit_length())
        self.keys, self.ranks = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, -1, np.int32)
        slot, left = self.slot(key), np.arange(len(key))
        while len(left):
            free = left[self.ranks[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or that of NONE."""
        shape, key = a.shape, self.key(a, b).reshape(-1)
        slot = self.slot(key)
        found = self.ranks[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != key))
        found[found < 0] = NONE >> PLACE
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            there = self.ranks[slot[wrong]]
            fits = self.keys[slot[wrong]] == key[wrong]
            found[wrong] = np.where(fits & (there >= 0), there, NONE >> PLACE)
            wrong = wrong[(there >= 0) & ~fits]
        return found.reshape(shape)

    def merged(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols by place and pre-token, and which of these are left; no pre-token has more than ``rows`` bytes."""
        n, every = len(starts), np.arange(len(starts))
        place = np.arange(rows, dtype=np.int32)[:, None]
        byte = data[np.minimum(starts + place, len(data) - 1)]
        left = place < size
        symbol = np.where(place == size - 1, self.last[byte], self.inner[byte])
        # one more row takes what is written beyond either end
        best = np.full((rows + 1, n), NONE, np.int32)
        if rows > 1:
            best[:-2] = np.where(place[1:] < size, self.rank(symbol[:-1], symbol[1:]) << PLACE | place[:-1], NONE)
        symbol = np.concatenate([symbol, symbol[:1]])
        left = np.concatenate([left, left[:1]])
        before, after = (np.repeat(np.arange(d, rows + 1 + d, dtype=np.int8)[:, None], n, axis=1) for d in (-1, 1))
        flat = [x.reshape(-1) for x in (symbol, left, best, before, after)]
        live = every
        while rows > 1:
            least = best.min(axis=0) if len(live) == n else best[:, live].min(axis=0)
            more = least < NONE
            live, least = live[more], least[more]
            if not len(live):
                break
            symbols, leaves, bests, befores, afters = flat
            at = (least & ((1 << PLACE) - 1)).astype(np.int64)
            spot = at * n + live
            gone = afters[spot].astype(np.int64) * n + live
            new, then, prior = self.into[least >> PLACE], afters[gone].astype(np.int64), befores[spot].astype(np.int64)
            symbols[spot], afters[spot] = new, then
            leaves[gone], bests[gone] = False, NONE
            follow, lead = then * n + live, np.where(prior < 0, rows, prior) * n + live
            inside = then < size[live]
            befores[follow] = at
            bests[spot] = np.where(inside, self.rank(new, symbols[follow]) << PLACE | at.astype(np.int32), NONE)
            bests[lead] = np.where(prior >= 0, self.rank(symbols[lead], new) << PLACE | prior.astype(np.int32), NONE)
        return symbol[:-1], left[:-1]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Subwords:
    _made: dict[str, Subwords] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.short = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER
        self.model = self.tokenizer.model
        self.merges = Merges(rules["model"]) if self.short and Merges.follows(rules["model"]) else None
        self.cache: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, path: str) -> Subwords:
        """The worker's own, made once."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        """Gives the caches' memory back: workers outlive their tasks, and others need it."""
        self.cache.clear()
        self.pieces.clear()
        self.held = 0

    def piece(self, text: str) -> bytes:
        shown = text if text.isascii() else "".join(map(LETTERS.__getitem__, text.encode()))
        ids = [t.id for t in self.model.tokenize(shown)]
        code = struct.pack(f"<{len(ids)}I", *ids)
        self.pieces[text] = code
        return code

    def learn(self, words: list[bytes]) -> None:
        if len(self.pieces) > CACHE_PIECES or self.held > CACHE_BYTES:
            self.pieces.clear()
        rest, cache, known = [], self.cache, self.pieces
        for word in words:
            text = word.decode("utf-8", "replace")
            if self.short and word.islower() and word.isalpha():  # ASCII letters alone are one pre-token
                cache[word] = known.get(text) or self.piece(text)
            elif self.short and PLAIN.fullmatch(text) and "<|" not in text:
                low = text.lower()
                if low in known:
                    cache[word] = known[low]
                else:
                    parts = PIECE.findall(low)
                    cache[word] = b"".join([known.get(p) or self.piece(p) for p in parts])
            else:
                rest.append((word, text))
        for i in range(0, len(rest), BATCH):
            part = rest[i : i + BATCH]
            for (word, _), code in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                cache[word] = np.array(code.ids, dtype="<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text; splits at ASCII white space."""
        return self.ids_of([text])[0]

    def make_room(self) -> None:
        if len(self.cache) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0

    def ids_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words without white space, laid end to end, and how many each has."""
        self.make_room()
        cache = self.cache
        fresh = [w for w in words if w not in cache]
        self.learn(fresh)
        codes = list(map(cache.__getitem__, words))
        self.held += sum(map(len, fresh)) + sum(map(len, map(cache.__getitem__, fresh)))
        return np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) // 4

    def ids_of_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids_of_words``, for words that are spans of ``data``, A-Z in lower case."""
        length = ends - starts
        into = np.concatenate([[0], np.cumsum(length)])
        raw = data[np.arange(into[-1]) + np.repeat(starts - into[:-1], length)]
        if self.merges is None or not len(raw):
            whole = raw.tobytes()
            return self.ids_of_words([whole[a:b] for a, b in zip(into[:-1].tolist(), into[1:].tolist(), strict=True)])
        first = np.zeros(len(raw) + 1, bool)
        first[into] = True
        begins = first[:-1]
        # signs, digits and a-z, or À to ÿ in two bytes without the signs among them
        pair = raw == 0xC3
        second = np.append(False, pair[:-1]) & ~begins & (raw >= 0x80) & (raw <= 0xBF) & (raw != 0x97) & (raw != 0xB7)
        fits = ((raw >= 0x21) & (raw <= 0x7E) & ((raw < 65) | (raw > 90))) | second | (pair & np.append(second[1:], False))
        fits &= ~((raw == 60) & np.append(raw[1:] == 124, False))  # "<|" begins the tokenizer's own words
        raw = np.where(second & (raw < 0x9F), raw + np.uint8(32), raw)
        # pre-tokens: runs of letters, single digits, runs of signs
        letter, digit = LETTER[raw], DIGIT[raw]
        cut = begins | digit | np.append(True, (letter[1:] != letter[:-1]) | digit[:-1])
        quote = np.flatnonzero(cut & (raw == 39))
        if len(quote):  # 's, 't, 're, 've, 'm, 'll, 'd
            padded, ahead = np.append(raw, np.zeros(2, raw.dtype)), np.append(first, np.ones(2, bool))
            one, two = padded[quote + 1], padded[quote + 2]
            near = ~ahead[quote + 1]
            short = near & np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = near & ~ahead[quote + 2] & (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))
            mark = np.append(cut, np.zeros(2, bool))
            mark[quote[short | long] + 1] = False
            mark[quote[short] + 2] = True
            mark[quote[long] + 2] = False
            mark[quote[long] + 3 - (quote[long] + 3 > len(raw) + 1)] = True
            cut = mark[: len(raw)] | begins
        good = np.bincount(np.searchsorted(into, np.flatnonzero(~fits), side="right") - 1, minlength=len(length)) == 0
        cut &= np.repeat(good, length)
        at = np.flatnonzero(cut)
        stop = np.append(at[1:], len(raw))
        word = np.searchsorted(into, at, side="right") - 1
        size = np.minimum(stop, into[word + 1]) - at
        group = np.searchsorted(TOGETHER, size)
        number = np.zeros(len(at), np.int64)
        done = []
        for k, rows in enumerate(TOGETHER):
            every = np.flatnonzero(group == k)
            for i in range(0, len(every), AT_ONCE):
                own = every[i : i + AT_ONCE]
                symbol, left = self.merges.merged(raw, at[own], size[own], rows)
                number[own] = left.sum(axis=0)
                done.append((own, symbol, left))
        far = np.flatnonzero(group == len(TOGETHER)).tolist()
        codes = []
        for i in far:
            text = raw[at[i] : at[i] + size[i]].tobytes().decode()
            codes.append(np.array([t.id for t in self.model.tokenize(text if text.isascii() else "".join(map(LETTERS.__getitem__, text.encode())))], np.int64))
            number[i] = len(codes[-1])
        rest = np.flatnonzero(~good)
        whole, a, b = data.tobytes() if len(rest) else b"", starts.tolist(), ends.tolist()
        others, many = self.ids_of_words([whole[a[i] : b[i]] for i in rest.tolist()])
        total = np.bincount(word, number, len(length)).astype(np.int64)
        inside = np.cumsum(number) - number - (np.cumsum(total) - total)[word]
        total[rest] = many
        place = np.cumsum(total) - total
        out = np.empty(int(total.sum()), "<u4")
        spot = place[word] + inside
        for own, symbol, left in done:
            out[(spot[own] + np.cumsum(left, axis=0) - 1)[left]] = symbol[left]
        for i, ids in zip(far, codes, strict=True):
            out[spot[i] : spot[i] + len(ids)] = ids
        out[np.arange(len(others)) + np.repeat(place[rest] - np.cumsum(many) + many, many)] = others
        return out, total

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of many texts; new words of all of them are tokenised together."""
        self.make_room()
        new: set[bytes] = set()
        split = [t.split() for t in texts]
        for words in split:
            new.update(words)
        fresh = list(new.difference(self.cache))
        self.learn(fresh)
        self.held += sum(len(w) + len(self.cache[w]) for w in fresh)
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]
