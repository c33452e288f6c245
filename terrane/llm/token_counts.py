"""Token counts from a compiled finite-state tokenizer.

The tokenizer file is compiled into two deterministic transducers:

* ``SplitMachine`` cuts normalised text into words, in six states.
* ``MergeMachine`` reads the bytes of one word. A state holds, for the positions a
  later token can still begin at, the last token of the text up to there; a
  transition carries the change in the number of tokens. States are made on demand.
  That every prefix of a word has one last token, which any neighbour pair decides
  alone, is a property of byte-pair encodings; it makes long words linear.

Texts are cut into chunks, which run in lockstep. A chunk's state map carries the
tokens it emits (``ChunkMaps``); maps of neighbouring chunks compose, and a parallel
prefix scan over them gives each text its count. Counts of whole words are state
maps too, and are kept in a bounded memo.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of what a worker keeps: words, states, pairs. Beyond them it starts over, with the same results.
MEMO_WORDS, MEMO_STATES, MEMO_PAIRS = 400_000, 300_000, 1_000_000
#: Code points that a worker splits at a time.
FLUSH_CHARS = 2_000_000
#: Signs outside these (ASCII, composed Latin letters, punctuation) are left to the library's normaliser; for
#: the others it only lowers letters, apart from white space, which the splitter treats alike.
UNUSUAL = re.compile("[^\x00-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u203a\u20ac]").search
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeMachine:
    """Transducer of a word's bytes to its number of tokens, from a vocabulary with ``end`` on last letters."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.letters = byte_letters()
        self.end = end
        self.ids = vocab
        self.text = {i: t for t, i in vocab.items()}
        self.rank = {}
        for n, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), (n, vocab[a + b]))
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(end)}
        self.final = {t[: -len(end)]: i for t, i in vocab.items() if t.endswith(end)}
        self.starts = {t[:k] for t in vocab for k in range(1, len(t) + 1)}
        self.reset()

    def reset(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.ends: list[dict[int, int]] = []
        self.start = self.intern(("", (-1,), (0,)))

    def intern(self, state: tuple) -> int:
        n = self.states.get(state)
        if n is None:
            n = self.states[state] = len(self.known)
            self.known.append(state)
            self.moves.append({})
            self.ends.append({})
        return n

    def symbols(self, token: int) -> list[int]:
        t = self.text[token]
        last = t.endswith(self.end) and len(t) > len(self.end)
        body = t[: -len(self.end)] if last else t
        out = [self.ids[c] for c in body]
        if last:
            out[-1] = self.ids[body[-1] + self.end]
        return out

    def merged(self, row: list[int]) -> list[int]:
        rank = self.rank
        while len(row) > 1:
            best = min((rank[p] for p in zip(row, row[1:]) if p in rank), default=None)
            if best is None:
                return row
            n, new = best
            out, i = [], 0
            while i < len(row):
                if i + 1 < len(row) and rank.get((row[i], row[i + 1]), (-1,))[0] == n:
                    out.append(new)
                    i += 2
                else:
                    out.append(row[i])
                    i += 1
            row = out
        return row

    def stands(self, left: int, right: int) -> bool:
        """Do the two tokens stay as they are side by side? left: -1 at the start of a word."""
        key = (left + 1) << 20 | right
        ok = self.pairs.get(key)
        if ok is None:
            want = [right] if left < 0 else [left, right]
            ok = self.merged((self.symbols(left) if left >= 0 else []) + self.symbols(right)) == want
            self.pairs[key] = ok
        return ok

    def last_token(self, text: str, last: tuple, tokens: dict[str, int]) -> tuple[int, int]:
        for at in range(len(text)):
            t = tokens.get(text[at:])
            if t is not None and self.stands(last[at], t):
                return at, t
        raise ValueError(f"no token ends {text!r}")

    def move(self, n: int, byte: int) -> tuple[int, int]:
        seen, last, count = self.known[n]
        text = seen + self.letters[byte]
        at, token = self.last_token(text, last, self.inner)
        delta = count[at] + 1
        cut = 0
        while cut < len(text) and text[cut:] not in self.starts:
            cut += 1
        to = self.intern((text[cut:], last[cut:] + (token,), tuple(c - delta for c in count[cut:]) + (0,)))
        out = self.moves[n][byte] = (to, delta)
        return out

    def close(self, n: int, byte: int) -> int:
        seen, last, count = self.known[n]
        at, _ = self.last_token(seen + self.letters[byte], last, self.final)
        out = self.ends[n][byte] = count[at] + 1
        return out

    def count(self, word: bytes) -> int:
        if len(self.known) > MEMO_STATES or len(self.pairs) > MEMO_PAIRS:
            self.reset()
        n, total, moves = self.start, 0, self.moves
        for b in word[:-1]:
            step = moves[n].get(b)
            if step is None:
                step = self.move(n, b)
            n = step[0]
            total += step[1]
            if len(self.known) > 2 * MEMO_STATES:  # a huge word: keep the state it is in
                state = self.known[n]
                self.reset()
                n, moves = self.intern(state), self.moves
        b = word[-1]
        step = self.ends[n].get(b)
        return total + (self.close(n, b) if step is None else step)


class WordCounts(dict):
    def __init__(self, machine: MergeMachine):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        out = self.machine.count(word.encode())
        if len(word) < 64:
            self[word] = out
        return out


#: Classes of code points and states of the splitting machine, for the pattern below.
SPACE, QUOTE, STMD, RV, EL, EE, LETTER, NUMBER, OTHER = range(9)
BETWEEN, WORD, RUN, QUOTED, QUOTED_RV, QUOTED_L = range(6)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def split_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """next state, "a token starts here" and "a token started one before", by state * 9 + class.

    After a quote that opens a token, a contraction wins over the run of other
    signs; r, v and l after it wait for the letter that decides.
    """
    letters = (STMD, RV, EL, EE, LETTER)
    to, here, before = np.zeros(54, np.uint8), np.zeros(54, bool), np.zeros(54, bool)

    def fresh(c: int) -> tuple[int, bool]:
        return {SPACE: (BETWEEN, False), QUOTE: (QUOTED, True), NUMBER: (BETWEEN, True), OTHER: (RUN, True)}.get(c, (WORD, True))

    for s in range(6):
        for c in range(9):
            nxt, new, back = *fresh(c), False
            if s == WORD and c in letters:
                nxt, new = WORD, False
            elif s == RUN and c in (QUOTE, OTHER):
                nxt, new = RUN, False
            elif s == QUOTED:
                if c in (QUOTE, OTHER):
                    nxt, new = RUN, False
                elif c == STMD:
                    nxt, new = BETWEEN, False
                elif c == RV:
                    nxt, new = QUOTED_RV, False
                elif c == EL:
                    nxt, new = QUOTED_L, False
            elif s in (QUOTED_RV, QUOTED_L):
                if c == (EE if s == QUOTED_RV else EL):
                    nxt, new = BETWEEN, False
                else:
                    back = True
                    if c in letters:
                        nxt, new = WORD, False
            to[s * 9 + c], here[s * 9 + c], before[s * 9 + c] = nxt, new, back
    return to, here, before


def letter_classes(split) -> np.ndarray:
    """The class of every code point, as the library's own splitter sees it."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out = np.full(0x110000, SPACE, np.uint8)
    for lo in range(0, len(points), 200_000):
        part = points[lo : lo + 200_000]
        # "a?a" is one piece for a letter; "!?!" is one piece for another sign; spaces are no piece
        in_word = split("\n".join(f"a{chr(c)}a" for c in part))
        in_run = split("\n".join(f"!{chr(c)}!" for c in part))
        starts = np.cumsum([0] + [4] * (len(part) - 1))
        long_word = {a for _, (a, b) in in_word if b - a == 3}
        long_run = {a for _, (a, b) in in_run if b - a == 3}
        middle = {a for _, (a, b) in in_run if b - a == 1}
        for c, at in zip(part, starts.tolist()):
            if at in long_word:
                out[c] = LETTER
            elif at in long_run:
                out[c] = OTHER
            elif at + 1 in middle:
                out[c] = NUMBER
    for chars, kind in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", EL), ("e", EE)):
        for c in chars:
            out[ord(c)] = kind
    return out


@functools.cache
def packed_classes() -> bytes:
    from tokenizers import Regex, pre_tokenizers

    cut = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)
    return zlib.compress(letter_classes(cut.pre_tokenize_str).tobytes())


class SplitMachine:
    def __init__(self, classes: np.ndarray):
        self.classes = classes
        self.to, self.here, self.before = split_tables()
        self.steps = list(zip(self.to.tolist(), self.here.tolist(), self.before.tolist()))

    def kinds(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def cut(self, run: str) -> list[int]:
        """Starts of the tokens of ``run``, which holds no white space, one sign after the other."""
        out, state = [], BETWEEN
        for i, kind in enumerate([*self.kinds(run).tolist(), SPACE]):
            state, here, before = self.steps[state * 9 + kind]
            if before:
                out.append(i - 1)
            if here:
                out.append(i)
        return out

    def starts(self, lanes: np.ndarray) -> np.ndarray:
        """Where tokens start in the columns of ``lanes``, all run in lockstep, each as after white space."""
        state = np.zeros(lanes.shape[1], np.uint8)
        here, before = np.empty(lanes.shape, bool), np.empty(lanes.shape, bool)
        for k, column in enumerate(lanes):
            at = state * np.uint8(9) + column
            here[k], before[k] = self.here[at], self.before[at]
            state = self.to[at]
        here[:-1] |= before[1:]
        return here


class RunCounts(dict):
    """Tokens of whole runs between white space: the transducers of splitting and merging, one after the other."""

    def __init__(self, split: SplitMachine, words: WordCounts):
        super().__init__()
        self.split, self.words = split, words

    def __missing__(self, run: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        at = self.split.cut(run)
        out = sum(self.words[run[a:b]] for a, b in zip(at, [*at[1:], len(run)]))
        if len(run) < 64:
            self[run] = out
        return out


class ChunkMaps:
    """State maps of the chunks of a text, and their composition.

    White space takes every state to the same one. So the map of a chunk with white
    space is: what the entry state makes of the chunk's head (up to its first white
    space), then a count that no longer depends on it, then the state in which the
    open tail (behind its last white space) leaves the transducer. A chunk without
    white space only prolongs what is open. A state is named by the open text that
    leads to it, which is contiguous, so a map is four numbers: has it white space,
    where its head ends, the tokens emitted between, where its tail starts.
    """

    def __init__(self, text: str, runs: RunCounts, synced: np.ndarray, head_end: np.ndarray, emitted: np.ndarray, tail: np.ndarray):
        self.text, self.runs = text, runs
        self.synced, self.head_end, self.emitted, self.tail = synced, head_end, emitted, tail

    def tokens(self, a: int, b: int) -> int:
        return self.runs[self.text[a:b]] if a < b else 0

    def enter(self, first: np.ndarray, begin: np.ndarray) -> None:
        """Fixes the entry state of the chunks ``first`` to that of a text's beginning."""
        for i, a in zip(first.tolist(), begin.tolist()):
            if self.synced[i]:
                self.emitted[i] += self.tokens(a, int(self.head_end[i]))
            else:
                self.tail[i] = a
            self.synced[i], self.head_end[i] = True, a

    def compose(self, left: np.ndarray, right: np.ndarray) -> None:
        """right := left, then right; all pairs at once."""
        l_sync, r_sync = self.synced[left], self.synced[right]
        emitted = np.where(r_sync & ~l_sync, self.emitted[right], self.emitted[left])
        for k in np.flatnonzero(l_sync & r_sync).tolist():
            i, j = left[k], right[k]
            emitted[k] += self.tokens(int(self.tail[i]), int(self.head_end[j])) + self.emitted[j]
        head_end = np.where(l_sync, self.head_end[left], self.head_end[right])
        tail = np.where(r_sync, self.tail[right], self.tail[left])
        self.emitted[right], self.head_end[right], self.tail[right], self.synced[right] = emitted, head_end, tail, l_sync | r_sync

    def scan(self, place: np.ndarray) -> None:
        """Inclusive prefix scan within texts, by doubling; place: a chunk's number within its text."""
        step, most = 1, int(place.max(initial=0))
        while step <= most:
            right = np.flatnonzero(place >= step)
            self.compose(right - step, right)
            step *= 2


class Counter:
    """Counts of whole texts; texts with a special token's string go to the library itself."""

    def __init__(self, path: str, classes: np.ndarray):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        model = spec["model"]
        self.words = WordCounts(MergeMachine(model["vocab"], model["merges"], model["end_of_word_suffix"]))
        self.split = SplitMachine(classes)
        self.runs = RunCounts(self.split, self.words)

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        held: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if "<|" in t and any(s in t for s in self.special):
                out[i] = len(self.library.encode(t, add_special_tokens=False).ids)
                continue
            held.append(i)
            size += len(t)
            if size > FLUSH_CHARS:
                out[held] = self._flush([texts[k] for k in held])
                held, size = [], 0
        if held:
            out[held] = self._flush([texts[k] for k in held])
        return out

    def _flush(self, texts: list[str]) -> np.ndarray:
        norm = self.library.normalizer.normalize_str
        return self.scanned([(t.lower() if t.isascii() or not UNUSUAL(t) else norm(t)) + "\n" for t in texts])

    def scanned(self, parts: list[str], width: int = 0) -> np.ndarray:
        """Counts of normalised texts, each of which ends in white space, over chunks of ``width`` code points."""
        text = "".join(parts)
        kinds = self.split.kinds(text)
        size = np.array([len(p) for p in parts])
        begin = np.cumsum(size) - size
        width = width or max(64, int(len(kinds) ** 0.5) // 2)
        chunks = -(-size // width)
        doc = np.repeat(np.arange(len(parts)), chunks)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        lo = begin[doc] + place * width
        hi = np.minimum(lo + width, (begin + size)[doc])
        at = lo[:, None] + np.arange(width)
        inside = at < hi[:, None]
        lanes = np.where(inside, kinds[np.minimum(at, len(kinds) - 1)], np.uint8(SPACE))
        blank = (lanes == SPACE) & inside
        synced = blank.any(1)
        first = np.where(synced, blank.argmax(1), hi - lo)
        last = np.where(synced, width - 1 - blank[:, ::-1].argmax(1), -1)
        starts = self.split.starts(np.ascontiguousarray(lanes.T)).T
        column = np.arange(width)
        starts &= (column > first[:, None]) & (column < last[:, None])
        row, col = np.nonzero((starts | blank) & synced[:, None])
        is_start = starts[row, col]
        a = (lo[row] + col)[is_start]
        b = (lo[row] + col)[np.flatnonzero(is_start) + 1]  # a chunk's last white space follows its last start
        words = self.words
        got = np.fromiter((words[text[i:j]] for i, j in zip(a.tolist(), b.tolist())), np.int64, len(a))
        emitted = np.bincount(row[is_start], got, len(lo)).astype(np.int64)
        maps = ChunkMaps(text, self.runs, synced, lo + first, emitted, lo + last + 1)
        begins = np.flatnonzero(place == 0)
        maps.enter(begins, lo[begins])
        maps.scan(place)
        return maps.emitted[np.append(begins[1:], len(lo)) - 1]


@functools.lru_cache(maxsize=1)
def counter_of(path: str, packed: bytes) -> Counter:
    """The compiled tokenizer of a worker process, with its bounded memos: made by its first task, used by all."""
    return Counter(path, np.frombuffer(zlib.decompress(packed), np.uint8))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of ``docs``.

    tokenizer: path of a byte-level BPE file with word ends and PATTERN as its
    splitter. One row out per row in, repeated and null ids included; a null text
    counts as empty; an empty text has 0 tokens. Other columns are ignored, so
    their names cannot clash. Ids pass through unread. One pass without a shuffle.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
        raise ValueError("the splitting machine is compiled for another pattern")
    packed = packed_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer, packed)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = counter.counts(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
