"""A byte-level BPE vocabulary as arrays, read from a tokenizer file by its path.

Loaded once per Python worker.  Normalising and cutting into words is left to the file's own
components in the tokenizers library, so their Unicode tables agree; merging is done here.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa

#: Letters, numbers and blanks among the first 256 characters, for texts that hold no others.
LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
BLANKS = "\\t-\\r \\x85\\xa0"
#: Fixed value: the words of byte-level BPE where the tokenizer file names no pattern of its own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d|"
END, GAP = "\ue000", "\ue001"
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and pair compatibility.  ``rank`` is a token's place among the merges, -1
    for single symbols; ``left`` and ``right`` are the two tokens it was merged from."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") \
            if self.special else None
        self.fast = simple_pattern(spec)
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.alphabet = [self.ids[letter] for letter in letters]
        self.ending = [self.ids[letter + self.suffix] for letter in letters]
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self._merges(model["merges"])
        self._bytes(letters)
        self._automaton()

    def _automaton(self) -> None:
        """Longest matches over the tokens that encode to themselves."""
        import ahocorasick

        tokens = list(self.ids)
        merged = self.merge_all([self._symbols(t) for t in tokens])
        self.whole = ahocorasick.Automaton()
        for token, symbols in zip(tokens, merged, strict=True):
            if symbols == [self.ids[token]]:
                word = token.removesuffix(self.suffix) if self.suffix else token
                word += END * (word != token)
                self.whole.add_word(word[::-1] if self.suffix else word, self.ids[token])
        self.whole.make_automaton()
        self.width = np.zeros(self.size, dtype=np.int64)
        for token, i in self.ids.items():
            word = token.removesuffix(self.suffix) if self.suffix else token
            self.width[i] = len(word) + (word != token)

    def _merges(self, merges) -> None:
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for place, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = self.ids[a + b]
            pairs[self.ids[a], self.ids[b]] = (place, made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = \
                    place, self.ids[a], self.ids[b]
        keys = np.array([a * self.size + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NEVER)
        self.places = np.append(np.array([p for p, _ in pairs.values()])[order], NEVER)
        self.made = np.append(np.array([m for _, m in pairs.values()])[order], 0)

    def _bytes(self, letters: list[str]) -> None:
        """The bytes each token decodes to, end to end, and where each begins."""
        of = {letter: b for b, letter in enumerate(letters)}
        parts = [b""] * self.size
        for token, i in self.ids.items():
            end = token.removesuffix(self.suffix) if self.suffix else token
            parts[i] = bytes(of[c] for c in end) + b" " * (end is not token and end != token)
        for token, i in self.special.items():
            parts[i] = token.encode()
        self.byte_start = np.cumsum([0, *map(len, parts)])
        self.byte_flat = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def _symbols(self, token: str) -> list[int]:
        word = token.removesuffix(self.suffix) if self.suffix else token
        out = [self.ids[c] for c in word]
        if word != token:
            out[-1] = self.ids[word[-1] + self.suffix]
        return out

    def places_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the merge of each pair, ``NEVER`` where there is none, and what it makes."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.places[at], NEVER), self.made[at]

    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """Exact merging of all words side by side, those of like length together: in each
        step every word does its earliest merge, the leftmost of equal ones."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        begin = 0
        while begin < len(order):
            width = int(sizes[order[begin]])
            most = max(1, min(20_000, (1 << 22) // max(width, 1)))
            end = begin + int(np.searchsorted(
                sizes[order[begin:begin + most]], width * 5 // 4, side="right"))
            part = order[begin:max(end, begin + 1)]
            for k, tokens in zip(part, self._merge_like([words[k] for k in part]), strict=True):
                out[k] = tokens
            begin = max(end, begin + 1)
        return out

    def _merge_like(self, words: list[list[int]]) -> list[list[int]]:
        n, width = len(words), max(map(len, words), default=0)
        if width == 0:
            return [[] for _ in words]
        token = np.full((n, width + 1), -1, dtype=np.int64)
        for k, w in enumerate(words):
            token[k, :len(w)] = w
        place = np.full((n, width), NEVER)
        made = np.zeros((n, width), dtype=np.int64)
        rows, cols = np.nonzero(token[:, 1:] >= 0)
        place[rows, cols], made[rows, cols] = self.places_of(
            token[rows, cols], token[rows, cols + 1])
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        live = np.arange(n)
        while len(live):
            at = place[live].argmin(axis=1)
            on = place[live, at] != NEVER
            live, at = live[on], at[on]
            gone = after[live, at]
            token[live, at] = made[live, at]
            place[live, np.minimum(gone, width - 1)] = NEVER
            token[live, gone] = -1
            then = np.minimum(after[live, gone], width)
            after[live, at] = then
            before[live, then] = at
            self._renew(place, made, token, live, at, then)
            prior = before[live, at]
            has = prior >= 0
            self._renew(place, made, token, live[has], prior[has], at[has])
        return [row[row >= 0].tolist() for row in token]

    def _renew(self, place, made, token, rows, a, b) -> None:
        left, right = token[rows, a], token[rows, b]
        new, what = self.places_of(left, right)
        place[rows, a] = np.where(right >= 0, new, NEVER)
        made[rows, a] = what

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches for all words, from the end where words have an end mark:
        their tokens end to end, and how many each."""
        ending = END + GAP if self.suffix else GAP
        text = ending.join(words) + ending
        found = list(self.whole.iter_long(text[::-1] if self.suffix else text))
        at = np.fromiter((e for e, _ in found), np.int64, len(found))
        tokens = np.fromiter((t for _, t in found), np.int64, len(found))
        if self.suffix:
            at, tokens = len(text) - 1 - at[::-1], tokens[::-1]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes + len(ending))
        of = np.searchsorted(ends, at, side="right")
        return tokens, np.bincount(of, minlength=len(words))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of two tokens side by side leaves both as they are.

        The tokens are taken apart again, the one made last first.  If two parts that then face
        each other have a merge that comes before the step just undone, it would have crossed.
        """
        fine = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), NEVER)
        while len(live):
            crossing = self.places_of(a, b)[0] < limit
            fine[live[crossing]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossing & ((ra >= 0) | (rb >= 0))
            first = ra > rb
            limit = np.where(first, ra, rb + 1)[go]
            a, b = np.where(first, self.right[a], a)[go], np.where(first, b, self.left[b])[go]
            live = live[go]
        return fine

    def words_of(self, text: str) -> list[str]:
        """The words of a text, normalised: by pattern where all characters are among the
        first 256, else by the tokenizers library."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            if self.fast:
                return self.fast.findall(text.lower() if self.suffix else text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Speculate and verify: longest matches for every word, one check of all neighbours,
        exact merging for the words that fail it.  Tokens end to end, and how many each."""
        table = self.letters
        spelled = [w.encode().decode("latin-1").translate(table) for w in words]
        tokens, counts = self.propose(spelled)
        of = np.repeat(np.arange(len(words)), counts)
        wrong = np.bincount(of, self.width[tokens], len(words)) != np.array(
            [len(w) for w in spelled]) + bool(self.suffix)
        inner = np.flatnonzero(of[1:] == of[:-1])
        wrong[of[inner[~self.compatible(tokens[inner], tokens[inner + 1])]]] = True
        redo = np.flatnonzero(wrong)
        if not len(redo):
            return tokens, counts
        merged = self.merge_all([self._spell(words[k]) for k in redo])
        good = ~wrong[of]
        flat = np.concatenate([tokens[good], np.array([t for m in merged for t in m], np.int64)])
        owner = np.concatenate([of[good], np.repeat(redo, [len(m) for m in merged])])
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _spell(self, word: str) -> list[int]:
        raw = word.encode()
        return [*(self.alphabet[b] for b in raw[:-1]),
                self.ending[raw[-1]]] if raw else []


def simple_pattern(spec: dict) -> re.Pattern | None:
    """The file's word pattern for texts of the first 256 characters, for the two kinds of
    tokenizer file known here: plain byte level, and lower-cased words without blanks."""
    cutter, normalizer = spec["pre_tokenizer"], spec["normalizer"]
    if cutter["type"] == "ByteLevel" and cutter["use_regex"] and normalizer is None \
            and not cutter["add_prefix_space"]:
        pattern = BYTE_LEVEL
    elif cutter["type"] == "Sequence" and normalizer and normalizer["type"] == "Sequence" \
            and [n["type"] for n in normalizer["normalizers"]] == ["NFC", "Replace", "Lowercase"] \
            and [c["type"] for c in cutter["pretokenizers"]] == ["Split", "ByteLevel"]:
        pattern = cutter["pretokenizers"][0]["pattern"]["Regex"]
    else:
        return None
    for name, chars in ((r"[\p{L}]", f"[{LETTERS}]"), (r"[\p{N}]", f"[{NUMBERS}]"),
                        (r"[^\s\p{L}\p{N}]", f"[^{BLANKS}{LETTERS}{NUMBERS}]"),
                        (r"\p{L}", f"[{LETTERS}]"), (r"\p{N}", f"[{NUMBERS}]"),
                        (r"\s", f"[{BLANKS}]"), (r"\S", f"[^{BLANKS}]")):
        pattern = pattern.replace(name, chars)
    if pattern.startswith(CONTRACTIONS):
        # No word of letters begins with an apostrophe, so words may be tried first.
        words, rest = pattern.removeprefix(CONTRACTIONS).split("|", 1)
        pattern = f"{words}|{CONTRACTIONS}{rest}"
    return re.compile(pattern)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts; what each word becomes is remembered, up to about ``room`` words.  Beyond
    that, words met only once go, and of the others the rarer ones if they are over half."""

    def __init__(self, vocab: Vocabulary, room: int = 400_000):
        self.vocab, self.room = vocab, room
        self.codes: dict[str, int] = {}
        self.start, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.uses = np.zeros(0, dtype=np.int64)

    def _forget(self) -> None:
        least = 2
        if self.room and np.count_nonzero(self.uses >= least) > self.room // 2:
            least = int(np.partition(self.uses, -(self.room // 2))[-(self.room // 2)]) + 1
        kept = np.flatnonzero(self.uses >= least)
        stays = self.uses >= least
        # Words stand in the order of their codes, so those that stay are numbered in turn.
        self.codes = dict(zip([w for w, s in zip(self.codes, stays, strict=True) if s],
                              range(len(kept)), strict=True))
        self.flat, self.start = gather(self.flat, self.start, kept, np.ones(len(kept), dtype=int))
        self.uses = self.uses[kept] // 2

    def _learn(self, words: list[str]) -> None:
        tokens, counts = self.vocab.encode_words(words)
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(words)),
                              strict=True))
        self.flat = np.concatenate([self.flat, tokens.astype(np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
        self.uses = np.append(self.uses, np.zeros(len(words), dtype=np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin (one entry more than texts)."""
        special = self.vocab.special
        parts, of = [], []
        for k, text in enumerate(texts):
            cut = self.vocab.special_cut.split(text) if any(s in text for s in special) else [text]
            parts += cut
            of += [k] * len(cut)
        each = [[] if p in special else self.vocab.words_of(p) for p in parts]
        every = [w for ws in each for w in ws]
        if len(self.codes) > self.room:
            self._forget()
        new = list(set(every).difference(self.codes))
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.codes.__getitem__, every), np.int64, len(every))
        self.uses += np.bincount(codes, minlength=len(self.uses))
        flat, start = gather(self.flat, self.start, codes, np.array(list(map(len, each)), int))
        if len(parts) > len(texts):
            return self._with_special(parts, of, flat, start, len(texts))
        return flat, start

    def _with_special(self, parts, of, flat, start, n):
        pieces = [np.array([self.vocab.special[p]], np.int32) if p in self.vocab.special
                  else flat[start[k]:start[k + 1]] for k, p in enumerate(parts)]
        sizes = np.bincount(of, [len(p) for p in pieces], n).astype(np.int64)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's own; it keeps what it remembers from task to task."""
    return Encoder(vocabulary(path))


def gather(flat, start, codes, counts):
    """The pieces of ``flat`` that ``codes`` name, end to end, and where each group of
    ``counts`` codes begins."""
    first, sizes = start[codes], start[codes + 1] - start[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total) + np.repeat(first - (ends - sizes), sizes)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return flat[where], np.concatenate([[0], ends])[bounds]


def slices(texts: pa.Array, most_bytes: int = 1 << 19):
    """Lists of texts of about ``most_bytes``; null becomes empty."""
    held, size = [], 0
    for text in texts:
        value = text.as_py() or ""
        held.append(value)
        size += len(value)
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held
