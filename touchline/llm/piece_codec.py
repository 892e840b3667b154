"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding takes the segmentation with the largest sum of piece scores (the unigram rule) under the scores of a
model file. A text is cut into chunks of fixed length. A piece may straddle a chunk's end, so what passes
between chunks is how far the last piece reaches: the boundary state. Three steps, each over chunks in parallel:

1. every chunk gives its transfer matrix: best score from each state at its start to each state at its end;
2. matrices of one text are combined by max-plus products, associative, in a doubling scan, which gives the best
   scores of all states in front of each chunk;
3. from these each chunk is backtraced on its own, for every state it may end in; the chain of states then picks.

Scores are whole numbers in fixed point, so the result does not depend on the chunk length. Of equal sums the
path with the longest last piece wins, at each position. A text of up to one chunk is a chain of one: the same code.

Within a chunk, positions that no piece of the vocabulary can span are cuts: in front of a space that follows
another character, and around characters in no longer piece. Words between cuts are solved together, those of one length
side by side over a table of the vocabulary's trie; common ones are remembered.

The file's normaliser must be the identity with a dummy prefix (checked). Characters outside the vocabulary become
UTF-8 byte pieces at ten below the least score. A literal U+2581 counts as such a character, not as a space, so
decoding always gives the text back. Null and empty texts have no pieces and decode to the empty text. Repeated
rows and repeated keys are encoded each; equal giant texts are solved once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 65536        # code points; longer texts are giants
SCALE = 1000  # fixed point of scores
NEVER = -(1 << 61)
REMEMBERED = 60_000  # words kept between cuts, per worker
TABLE_CHARACTERS = 191  # most frequent characters of the vocabulary, which the trie table covers
TABLE_WORD = 100     # longest word solved by the table
TEXTS, CHARACTERS = 512, 1_000_000  # most texts, and about most characters, whose words are solved together


class Vocabulary:
    """Pieces and scores of a model file, and the chunk solver over them."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.decode(model.encode("  a  b ")) != "  a  b ":
            raise ValueError("needs a model that keeps text as it is, with a dummy prefix")
        self.pieces: dict[str, tuple[int, int]] = {}
        self.byte_ids: dict[int, int] = {}
        self.bytes_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.pieces[text] = (i, round(model.get_score(i) * SCALE))
                self.bytes_of.append(text.encode())
        if len(self.byte_ids) != 256:
            raise ValueError("needs a model with byte pieces")
        if any(re.search("[^ ] ", p) for p in self.pieces):
            raise ValueError("needs pieces that hold spaces only in front")
        self.unknown = min(s for _, s in self.pieces.values()) - 10 * SCALE
        self.states = max(map(len, self.pieces))  # state i: the last piece reaches i characters beyond the boundary
        self.heads = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\r\t" if c not in joined)
        plain = f"[^ {re.escape(self.alone)}]"
        self.parts = re.compile(f" +{plain}*|{plain}+" + (f"|[{re.escape(self.alone)}]" if self.alone else ""))
        self.words: dict[str, list[int]] = {}
        self._table()

    def _table(self) -> None:
        """Trie over pieces of the most frequent characters: next node by node and character, score and id by node."""
        counts = Counter(c for p in self.pieces for c in p)
        usual = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c in self.pieces and ord(c) < 1 << 16][:TABLE_CHARACTERS]
        self.codes = np.zeros(1 << 16, np.uint8)
        for i, c in enumerate(usual):
            self.codes[ord(c)] = i + 1
        known = set(usual)
        nodes = {"": 1}
        steps = []
        for piece in self.pieces:
            if known.issuperset(piece):
                for n in range(1, len(piece) + 1):
                    if piece[:n] not in nodes:
                        nodes[piece[:n]] = len(nodes) + 1
                        steps.append((nodes[piece[:n - 1]], self.codes[ord(piece[n - 1])], nodes[piece[:n]]))
        self.next = np.zeros((len(nodes) + 1, len(usual) + 1), np.uint16 if len(nodes) < 65_000 else np.int32)
        at, code, to = (np.array(x) for x in zip(*steps))
        self.next[at, code] = to
        self.node_score = np.full(len(nodes) + 1, NEVER, np.int64)
        self.node_id = np.zeros(len(nodes) + 1, np.int32)
        for piece, node in nodes.items():
            if piece in self.pieces:
                self.node_id[node], self.node_score[node] = self.pieces[piece]

    def _solve_table(self, words: list[str], length: int) -> None:
        """Words of one length side by side; those with other characters one by one."""
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, length)
        code = np.where(text < 1 << 16, self.codes[np.minimum(text, (1 << 16) - 1)], 0)
        usual = (code > 0).all(axis=1)
        for i in np.flatnonzero(~usual).tolist():
            self.words[words[i]] = self.word(words[i])
        places = np.flatnonzero(usual)
        code, n = code[places], len(places)
        columns = [np.ascontiguousarray(code[:, e], np.int64) for e in range(length)]
        best = [np.zeros(n, np.int64)] + [np.full(n, NEVER, np.int64) for _ in range(length)]
        back, ident = np.zeros((length + 1, n), np.int8), np.zeros((length + 1, n), np.int32)
        following, width = self.next.ravel(), self.next.shape[1]
        for s in range(length):
            live, node, base = None, np.ones(n, np.int64), best[s]
            for e in range(s + 1, min(length, s + self.states) + 1):
                node = following[node * width + (columns[e - 1] if live is None else columns[e - 1][live])].astype(np.int64)
                keep = np.flatnonzero(node)
                if not len(keep):
                    break
                if len(keep) < len(node):
                    live, node, base = keep if live is None else live[keep], node[keep], base[keep]
                total = base + self.node_score[node]
                better = np.flatnonzero(total > (best[e] if live is None else best[e][live]))  # nodes that are no piece stay below
                at = better if live is None else live[better]
                best[e][at], back[e][at], ident[e][at] = total[better], s, self.node_id[node[better]]
        back, ident = back.T, ident.T
        for i, b, d in zip(places.tolist(), back.tolist(), ident.tolist()):
            ids, at = [], length
            while at:
                ids.append(d[at])
                at = b[at]
            ids.reverse()
            self.words[words[i]] = ids

    def forward(self, text: str, starts: dict[int, int], stop: int) -> tuple[list[int], list[int]]:
        """Best score to each position and where its last piece begins (-1: before the text). Pieces begin below
        `stop`; they may end beyond it, up to the text's end."""
        n, pieces, heads = len(text), self.pieces, self.heads
        best, back = [NEVER] * (n + 1), [-2] * (n + 1)
        for at, score in starts.items():
            if score > NEVER and at <= n:
                best[at], back[at] = score, -1
        for s in range(min(stop, n)):
            base = best[s]
            if base == NEVER:
                continue
            for e in range(s + 1, min(n, s + self.states) + 1):
                part = text[s:e]
                if part not in heads:
                    break
                if (hit := pieces.get(part)) and base + hit[1] > best[e]:
                    best[e], back[e] = base + hit[1], s
            if text[s] not in pieces and base + self.unknown > best[s + 1]:
                best[s + 1], back[s + 1] = base + self.unknown, s
        return best, back

    def trace(self, text: str, back: list[int], at: int) -> tuple[int, list[int]]:
        """Piece ids of the best path to `at`, and the position in front of its first piece in this text."""
        ids: list[int] = []
        while (s := back[at]) >= 0:
            hit = self.pieces.get(text[s:at])
            if hit:
                ids.append(hit[0])
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[s:at].encode()))
            at = s
        ids.reverse()
        return at, ids

    def word(self, text: str) -> list[int]:
        """Ids of a stretch between cuts, solved here."""
        return self.trace(text, self.forward(text, {0: 0}, len(text))[1], len(text))[1]

    def learn(self, parts: list[str]) -> None:
        """Solve the stretches between cuts that are not known yet."""
        words = self.words
        if len(words) > REMEMBERED:
            words.clear()
        by_length: dict[int, list[str]] = {}
        for w in set(parts).difference(words):
            by_length.setdefault(len(w), []).append(w)
        for length, new in by_length.items():
            if length <= TABLE_WORD and len(new) >= 16:
                self._solve_table(new, length)
            else:
                for w in new:
                    words[w] = self.word(w)

    def ids_of(self, parts: list[str]) -> list[int]:
        """Ids of stretches between cuts, in order."""
        self.learn(parts)
        return self._ids(parts).tolist()

    def _ids(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.words.__getitem__, parts)), np.int32)

    def cut_up(self, chunk: str, ahead: str) -> tuple[str, list[str], str]:
        """Head (up to the first cut, where an entering piece may still reach), whole words, tail (from the last cut
        that is not beyond the chunk, with what follows it). Without any cut all is tail."""
        parts = self.parts.findall(chunk + ahead)
        ends = np.cumsum([len(p) for p in parts])
        whole = int(np.searchsorted(ends, len(chunk), side="right"))  # parts that end in the chunk
        if not whole:
            return "", [], parts[0] if parts else ""
        return parts[0], parts[1:whole], parts[whole] if whole < len(parts) else ""

    def matrix(self, chunk: str, ahead: str) -> np.ndarray:
        """Max-plus transfer matrix of a chunk, less its largest entry."""
        head, words, tail = self.cut_up(chunk, ahead)
        size, out = self.states, np.full((self.states, self.states), NEVER, np.int64)
        inside = len(chunk) - len(head) - sum(map(len, words))  # of the tail
        if head:
            # words between the first and the last cut add the same to every entry
            last, _ = self.forward(tail, {0: 0}, inside)
            exits = {j: last[inside + j] for j in range(min(size, len(tail) - inside + 1)) if last[inside + j] > NEVER}
            rows = {i: self.forward(head, {i: 0}, len(head))[0][-1] for i in range(min(size, len(head) + 1))}
            found = {(i, j): a + b for i, a in rows.items() if a > NEVER for j, b in exits.items()}
        else:
            found = {}
            for i in range(min(size, len(tail) + 1)):
                last, _ = self.forward(tail, {i: 0}, inside)
                found |= {(i, j): last[inside + j] for j in range(min(size, len(tail) - inside + 1)) if last[inside + j] > NEVER}
        top = max(found.values(), default=0)
        for (i, j), v in found.items():
            out[i, j] = v - top
        return out

    def backtrace(self, chunk: str, ahead: str, entry: list[int]) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
        """Ids that every way through the chunk begins with, and for each state it may end in: (state, state it
        came from, further ids)."""
        head, words, tail = self.cut_up(chunk, ahead)
        size = self.states
        inside = len(chunk) - len(head) - sum(map(len, words))
        shared: list[int] = []
        came, starts = None, {i: v for i, v in enumerate(entry) if v > NEVER}
        if head:
            _, back = self.forward(head, starts, len(head))
            came, shared = self.trace(head, back, len(head))
            shared += self.ids_of(words)
            starts = {0: 0}
        best, back = self.forward(tail, starts, inside)
        ways = []
        for j in range(min(size, len(tail) - inside + 1)):
            if best[inside + j] > NEVER:
                at, ids = self.trace(tail, back, inside + j)
                ways.append((j, at if came is None else came, ids))
        return shared, ways

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of one chunk each."""
        cut = [self.parts.findall(" " + text) if text else [] for text in texts]
        self.learn([w for parts in cut for w in parts])
        return [self._ids(parts) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices, each less its largest entry."""
    out = (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)
    out = out - np.maximum(out.max(axis=(-1, -2), keepdims=True), NEVER // 2)
    return np.where(out < NEVER // 2, NEVER, out)


def prefixes(matrices: np.ndarray) -> np.ndarray:
    """All prefix products by doubling: step d joins each prefix with the one d places before."""
    out, d = matrices.copy(), 1
    while d < len(out):
        out[d:] = product(out[:-d], out[d:])
        d *= 2
    return out


def _chunks(text: str, size: int, ahead: int):
    whole = " " + text
    for k in range(0, -(-len(whole) // size)):
        yield k, whole[k * size:(k + 1) * size], whole[(k + 1) * size:(k + 1) * size + ahead]


def encode(df: DataFrame, key: str = "doc_id", column: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: key, ids, and round_trip (the ids decode to the text; null counts as empty)."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias(key), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    giant = F.length("text") >= chunk

    def small(source):
        vocab = vocabulary(model)

        def solved(held):
            for (ident, text), ids in zip(held, vocab.encode([t for _, t in held])):
                yield ident, ids, vocab.decode(ids.tolist()) == text

        held, size = [], 0
        for row in source:
            held.append(row)
            size += len(row[1])
            if len(held) >= TEXTS or size >= CHARACTERS:
                yield from solved(held)
                held, size = [], 0
        yield from solved(held)

    whole = arrow_rows(docs.where(~giant), f"`{key}` {kind}, ids array<int>, round_trip boolean", small)
    giants = docs.where(giant).withColumn("text_hash", F.sha2("text", 256))

    def matrices(source):
        vocab = vocabulary(model)
        for text, mark in source:
            for k, part, after in _chunks(text, chunk, vocab.states):
                yield mark, k, vocab.matrix(part, after).tobytes()

    steps = arrow_rows(giants.select("text", "text_hash"), "text_hash string, k int, matrix binary", matrices)

    def entries(key_columns, groups):
        import pyarrow as pa
        rows = dict(zip(groups.column("k").to_pylist(), groups.column("matrix").to_pylist()))
        places = sorted(rows)  # a repeated text gives equal rows
        size = vocabulary(model).states
        stack = np.stack([np.frombuffer(rows[k], np.int64).reshape(size, size) for k in places])
        first = np.full((1, size), NEVER, np.int64)
        first[0, 0] = 0
        before = np.concatenate([first, prefixes(stack)[:-1, 0, :]])
        return pa.table({"mark": pa.array([key_columns[0].as_py()] * len(places), pa.string()), "at": pa.array(places, pa.int32()),
                         "entry": pa.array(before.tolist(), pa.list_(pa.int64()))})

    # One group holds the matrices of one text, far smaller than the text, which is one row itself.
    states = steps.groupBy("text_hash").applyInArrow(entries, "mark string, at int, entry array<long>")

    def cut(source):
        ahead = vocabulary(model).states
        for text, mark in source:
            for k, part, after in _chunks(text, chunk, ahead):
                yield mark, k, part, after

    pieces = arrow_rows(giants.select("text", "text_hash"), "text_hash string, k int, part string, after string", cut)

    def solved(source):
        vocab = vocabulary(model)
        for mark, k, part, after, entry in source:
            shared, ways = vocab.backtrace(part, after, entry)
            yield mark, k, shared, [{"state": j, "came": i, "ids": ids} for j, i, ids in ways]

    placed = pieces.join(states, (F.col("text_hash") == F.col("mark")) & (F.col("k") == F.col("at")))
    ways = arrow_rows(placed.select("text_hash", "k", "part", "after", "entry"),
                      "text_hash string, k int, shared array<int>, ways array<struct<state:int,came:int,ids:array<int>>>", solved)

    def stitched(key_columns, groups):
        import pyarrow as pa
        rows = {k: (shared, options) for k, shared, options in zip(*(groups.column(c).to_pylist() for c in ("k", "shared", "ways")))}
        state, runs = 0, []
        for k in sorted(rows, reverse=True):
            shared, options = rows[k]
            way = next(w for w in options if w["state"] == state)
            runs += [way["ids"], shared]
            state = way["came"]
        ids = [i for r in reversed(runs) for i in r]
        mark = key_columns[0].as_py()
        same = hashlib.sha256(vocabulary(model).decode(ids).encode()).hexdigest() == mark
        return pa.table({"mark": pa.array([mark], pa.string()), "ids": pa.array([ids], pa.list_(pa.int32())), "round_trip": pa.array([same], pa.bool_())})

    long_ids = ways.groupBy("text_hash").applyInArrow(stitched, "mark string, ids array<int>, round_trip boolean")
    long = giants.select(key, "text_hash").join(long_ids, F.col("text_hash") == F.col("mark")).select(key, "ids", "round_trip")
    return whole.unionByName(long)


def decode(df: DataFrame, column: str = "ids", model: str = MODEL) -> DataFrame:
    """The same rows with the text of the ids in a last column, `decoded`; null ids give the empty text."""
    names = [c for c in df.columns if c != "decoded"]
    at = names.index(column)

    def rows(source):
        vocab = vocabulary(model)
        for row in source:
            yield (*row, vocab.decode(row[at] or []))

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return arrow_rows(df.select(*names), f"{schema}, decoded string", rows)


def encoded_documents(df: DataFrame) -> DataFrame:
    """doc_id, ids, their number, and whether decoding gives back the text."""
    return encode(df).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
