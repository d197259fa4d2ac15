"""Token ids of documents in binary files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in order, little-endian throughout:

    magic "PFOR1\\0\\0\\0"
    blocks: uint32 minimum; uint8 width; uint8 exceptions; the packed numbers;
            a position byte and a uint32 for each exception
    int64 per document: its id; int64 per document: number of ids before its end
    int64 per block, and one more: where its bytes begin after the magic word
    int64 documents, ids, blocks, and where the index of documents begins; the magic word again

A block is 128 ids (the last may have fewer). Its minimum is taken off; the width
is the bits that 90 of 100 of the rest need. Ids above it are stored whole in
the exception list, and 0 is packed in their place. The starts of the
blocks let a reader unpack any range of ids alone.
"""

from __future__ import annotations

import io
import itertools
import os
import re
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vlprep.llm.common import ENCODERS, slices, worker_cache
from vlprep.session import run_dir

MAGIC = b"PFOR1\0\0\0"
BLOCK = 128
PERCENT = 90
END_ID = 2
#: Stands for a null document id in a file.
NO_ID = -(1 << 63)
#: Pieces of text whose ids a worker remembers.
CACHE_PIECES = 800_000
#: New pieces that are encoded as one text.
JOINED = 500
# Fixed value: a space at the start of a byte-level token.
SPACE_TOKEN = "\u0120"
_CUT = re.compile(r"(?= [^\s])")
#: What stands for white space, or may do so, past ASCII.
_WHITE = np.array([0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_IS_WHITE = np.isin(np.arange(1 << 16), _WHITE)
_SOLID = "[^\\x00-\\x20\\x7f" + "".join(f"\\x{{{c:x}}}" for c in _WHITE.tolist()) + "]"
#: Pieces without white space, with a space before them and without.
_SPACED, _BARE = rf"^ {_SOLID}+$", rf"^{_SOLID}+$"
# Kinds of bytes. Those from _LETTER on begin characters that are no white space; 0 may be anything.
_SPACE, _NEWLINE, _LETTER, _DIGIT, _SYMBOL, _APOSTROPHE, _WIDE = range(1, 8)
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127], _KINDS[48:58], _KINDS[65:91], _KINDS[97:123], _KINDS[0xC2:0xF5] = _SYMBOL, _DIGIT, _LETTER, _LETTER, _WIDE
_KINDS[[32, 10, 39]] = _SPACE, _NEWLINE, _APOSTROPHE
#: By ``8 * kind + next kind``, whether a match surely ends between two bytes.
_APART = np.zeros(64, bool)
for _a, _b in itertools.product((_LETTER, _DIGIT, _SYMBOL, _APOSTROPHE), (_LETTER, _DIGIT, _SYMBOL, _APOSTROPHE, _NEWLINE)):
    _APART[_a << 3 | _b] = _a != _b and {_a, _b} != {_SYMBOL, _APOSTROPHE} and (_a, _b) != (_APOSTROPHE, _LETTER)
_FILES = pa.schema([("part", pa.int64()), ("first", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` numbers below ``2**width`` as rows of ``2 * width`` 64-bit words."""
    out = np.zeros((2 * width, len(rows)), np.uint64)
    columns = np.ascontiguousarray(rows.T).astype(np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, len(words)), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[i] = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= columns[word + 1] << np.uint64(64 - shift)
        out[i] &= mask
    return np.ascontiguousarray(out.T).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The block area for some ids, and where each block begins in it (with the end)."""
    n = -(-len(ids) // BLOCK)
    full = np.zeros(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    if n * BLOCK > len(ids):
        full[len(ids) :] = ids[-1]
    full = full.reshape(n, BLOCK)
    low = full.min(1)
    rest = full - low[:, None]
    width = _bits(np.partition(rest, BLOCK * PERCENT // 100 - 1, axis=1)[:, BLOCK * PERCENT // 100 - 1])
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    count = over.sum(1)
    starts = np.concatenate([[0], np.cumsum(6 + 16 * width + 5 * count)]).astype(np.int64)
    out = np.zeros(starts[-1], np.uint8)
    out[starts[:-1, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[starts[:-1] + 4] = width
    out[starts[:-1] + 5] = count
    packed = np.where(over, 0, rest)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            out[(starts[at] + 6)[:, None] + np.arange(16 * w)] = pack(packed[at], int(w)).astype("<u8").view(np.uint8).reshape(len(at), -1)
    block, place = np.nonzero(over)
    order = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[block] + 6 + 16 * width[block]
    out[at + order] = place
    at += count[block] + 4 * order
    out[at[:, None] + np.arange(4)] = full[over].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts


def decode_blocks(area: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All numbers of the blocks that begin at ``starts[:-1]`` of the byte array ``area``."""
    begin = starts[:-1]
    low = area[begin[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, count = area[begin + 4].astype(np.int64), area[begin + 5].astype(np.int64)
    out = np.zeros((len(begin), BLOCK), np.uint32)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            out[at] = unpack(area[(begin[at] + 6)[:, None] + np.arange(16 * w)].copy().view("<u8"), int(w))
    out += low[:, None]
    block = np.repeat(np.arange(len(begin)), count)
    order = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[block] + 6 + 16 * width[block]
    place = area[at + order]
    at += count[block] + 4 * order
    out[block, place] = area[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return out.ravel()


class FileWriter:
    """Writes documents to a file as they come; about ``CHUNK`` ids are packed at a time."""

    CHUNK = 1 << 20

    def __init__(self, sink=None):
        self.sink = io.BytesIO() if sink is None else sink
        self.sink.write(MAGIC)
        self.doc_ids, self.sizes, self.starts = [], [], [np.zeros(1, np.int64)]
        self.waiting, self.n_waiting, self.n_bytes = [], 0, 0

    def add(self, doc_ids: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and all their ids."""
        self.doc_ids.append(np.array(doc_ids, "<i8"))
        self.sizes.append(np.asarray(sizes, np.int64))
        self.waiting.append(ids.astype(np.uint32, copy=False))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.CHUNK:
            self._pack(self.n_waiting // BLOCK * BLOCK)

    def _pack(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        area, starts = encode_blocks(ids[:n])
        self.sink.write(area)
        self.starts.append(starts[1:] + self.n_bytes)
        self.n_bytes += len(area)
        self.waiting, self.n_waiting = [ids[n:].copy()], len(ids) - n

    def finish(self) -> tuple[int, int]:
        """Write what is left and the index; numbers of documents and ids."""
        if self.n_waiting:
            self._pack(self.n_waiting)
        sizes = np.concatenate([*self.sizes, np.empty(0, np.int64)])
        starts, ends = np.concatenate(self.starts), np.cumsum(sizes)
        n_ids = int(sizes.sum())
        for column in (*self.doc_ids, ends, starts, np.array([len(ends), n_ids, len(starts) - 1, len(MAGIC) + self.n_bytes])):
            self.sink.write(column.astype("<i8").tobytes())
        self.sink.write(MAGIC)
        return len(ends), n_ids


class TokenFile:
    """A file's index (``doc_ids``, ``ends``), and ids of any range. ``source`` is a file that can be read anywhere, or bytes."""

    def __init__(self, source):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        size = self.source.size()
        tail = self._read(max(0, size - 40), 40)
        if size < 48 or tail[32:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        docs, self.size, blocks, at = np.frombuffer(tail[:32], "<i8").tolist()
        index = np.frombuffer(self._read(at, 8 * (2 * docs + blocks + 1)), "<i8")
        self.doc_ids, self.ends, self.starts = index[:docs], index[docs : 2 * docs], index[2 * docs :]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, begin: int, end: int) -> np.ndarray:
        if end <= begin:
            return np.empty(0, np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        starts = self.starts[first : last + 1]
        area = np.frombuffer(self._read(len(MAGIC) + int(starts[0]), int(starts[-1] - starts[0])), np.uint8)
        return decode_blocks(area, starts - starts[0])[begin - first * BLOCK : end - first * BLOCK]


class PieceEncoder:
    """Ids of texts by a byte-level tokenizer file, each distinct piece encoded once.

    The tokenizer's pattern never joins a space that a non-space follows to what
    stands before it, so a text may be cut there and the pieces' ids put together. Where the pattern is
    that of the plain byte-level pre-tokenizer, which joins letters with letters, digits with digits and
    symbols with symbols, texts are also cut between these, and around the last newline before them (:meth:`_cuts`).
    New pieces are encoded some hundreds at a time, as one text: those that begin with a space one after the
    other, the first token of each is the only one that begins with its space; others with newlines between them.

    When more than ``cache_pieces`` are known, those that most calls had are kept, half as many at most.

    ``special_as_text`` reads strings of special tokens as ordinary text; the tokenizer's own way is to take them as these tokens.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, special_as_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.cache_pieces = Tokenizer.from_file(path), cache_pieces
        self.tokenizer.encode_special_tokens = special_as_text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced_token = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE_TOKEN) for i in range(size)])
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pattern = self.tokenizer.pre_tokenizer
        # a token with white space in it might arise where pieces meet
        self.joins = all(c.split() == [c] for c in self.added)
        self.plain = isinstance(pattern, ByteLevel) and pattern.use_regex and not pattern.add_prefix_space and self.tokenizer.normalizer is None
        newline = self._alone(["\n"])[0] if self.plain else []
        self.newline = int(newline[0]) if len(newline) == 1 else None
        # the letters of two bytes, as the tokenizer's own pattern takes them
        self.letters = np.array([self.plain and c >= 0x80 and [at for _, at in pattern.pre_tokenize_str(f"x{chr(c)}.")] == [(0, 2), (2, 3)] for c in range(0x800)])
        self.place: dict[bytes, int] = {}
        # place 0 is for the end id
        self.ids, self.begins, self.sizes, self.seen = np.zeros(1, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the pieces seen most often, at most half of ``cache_pieces``; what they were seen counts half from now on."""
        held = np.fromiter(self.place.values(), np.int64, len(self.place))
        often = np.bincount(np.minimum(self.seen[held], 1 << 10))
        # the lowest number of times, from 2, that few enough pieces were seen; of those of the highest kind all or none stay
        least = next((n for n in range(2, len(often)) if often[n:].sum() <= self.cache_pieces // 2), len(often))
        stays = self.seen[held] >= least
        held = held[stays]
        self.place = {p: i for i, p in enumerate(itertools.compress(self.place, stays.tolist()), 1)}
        held = np.insert(held, 0, 0)
        sizes = self.sizes[held]
        begins = np.cumsum(sizes) - sizes
        self.ids = self.ids[np.arange(int(sizes.sum())) + np.repeat(self.begins[held] - begins, sizes)]
        self.begins, self.sizes, self.seen = begins, sizes, self.seen[held] // 2

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[bytes], spaced: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of some pieces, of which all or none begin with a space and have no other white space, and the number of ids of each."""
        ids, sizes = [], []
        for begin in range(0, len(pieces), JOINED):
            part = pieces[begin : begin + JOINED]
            found = self._alone([(b"" if spaced else b"\n").join(part).decode()])[0]
            if spaced:
                ends = np.append(np.flatnonzero(self.spaced_token[found])[1:], len(found))
            else:
                between = found == self.newline
                ends = np.append(np.flatnonzero(between) - np.arange(between.sum()), len(found) - between.sum())
                found = found[~between]
            if len(ends) != len(part):  # not a byte-level tokenizer
                each = self._alone([p.decode() for p in part])
                found, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return ids, sizes

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of distinct pieces are kept; those not known are encoded first."""
        names = pieces.to_numpy(zero_copy_only=False).tolist()  # as one array, a tenth of the time of to_pylist
        places = np.fromiter(map(self.place.get, names, itertools.repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            strings = pieces.take(pa.array(missing)).cast(pa.large_string())
            spaced, bare = (pc.match_substring_regex(strings, p).to_numpy(zero_copy_only=False) for p in (_SPACED, _BARE))
            spaced &= self.joins
            bare &= self.joins and self.newline is not None
            # in this order they get their places
            missing = np.concatenate([missing[spaced], missing[bare], rest := missing[~(spaced | bare)]])
            new = [names[i] for i in missing.tolist()]
            n, m = int(spaced.sum()), len(new) - len(rest)
            ids, sizes = map(list.__add__, self._together(new[:n], True), self._together(new[n:m], False))
            ids += self._alone([p.decode() for p in new[m:]])
            sizes = np.concatenate([*sizes, [len(r) for r in ids[len(sizes) :]]]).astype(np.int64)
            places[missing] = np.arange(len(new)) + len(self.begins)
            self.place.update(zip(new, places[missing].tolist()))
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
            self.ids = np.concatenate([self.ids, *ids])
        self.seen[places] += 1
        return places

    def _cuts(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces of texts begin, the texts given as one array of bytes and where each ends in it.

        A cut is made only where the tokenizer's pattern is sure to end a match, and to match the same before the cut without what
        follows: before a space with a non-space after it, before and after a newline with a non-space after it,
        before a newline that follows a non-space, and between letters, digits and symbols, but for an apostrophe before a letter (``'s``).
        """
        kind = _KINDS[raw]
        lead = np.flatnonzero(kind == _WIDE)
        if len(lead):
            first, second = raw[lead].astype(np.int64), raw[lead + 1].astype(np.int64) & 63
            two = first < 0xE0
            code = np.where(two, (first & 31) << 6 | second, (first & 15) << 12 | second << 6)
            three = np.flatnonzero(~two & (first < 0xF0))
            code[three] |= raw[lead[three] + 2] & 63
            kind[lead[_IS_WHITE[code] & (first < 0xF0)]] = 0
            letter = lead[two & self.letters[np.where(two, code, 0)]]
            kind[letter] = kind[letter + 1] = _LETTER
        following = np.append(kind[1:], np.uint8(0))
        following[ends[ends > 0] - 1] = 0
        before_text = following >= _LETTER
        cut = (kind == _SPACE) & before_text
        if self.plain:
            newline = (kind == _NEWLINE) & before_text
            cut |= newline
            cut[1:] |= newline[:-1] | _APART[kind[:-1] << 3 | kind[1:]]
        begins = np.append(0, ends[:-1])
        cut[begins[begins < ends]] = True
        return np.flatnonzero(cut)

    def _encode(self, pieces: pa.Array, begins: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given by their pieces, and where each text's first piece is (and the end); the texts' numbers of ids."""
        coded = pieces.dictionary_encode()
        places = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        if end_id is not None:
            self.ids[0] = end_id
            places = np.insert(places, begins[1:], 0)
            begins = begins + np.arange(len(begins))
        sizes = self.sizes[places]
        after = np.append(0, np.cumsum(sizes))
        at = np.repeat(self.begins[places] - after[:-1], sizes)
        at += np.arange(len(at))
        return self.ids[at], np.diff(after[begins])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of some texts one after the other, each followed by ``end_id``, and the number of each text's ids."""
        if len(self.place) > self.cache_pieces:
            self._forget()
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        raw, ends = _bytes(texts)
        whole = raw.tobytes()
        odd = np.zeros(len(texts), bool)
        for content in self.added:
            if content.encode() in whole:
                odd |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        parts = []
        if not odd.all():
            if odd.any():
                raw, ends = _bytes(texts.filter(pa.array(~odd)))
            cuts = self._cuts(raw, ends)
            offsets = np.append(cuts, len(raw))
            pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            parts.append(self._encode(pieces, np.append(0, np.searchsorted(cuts, ends)), end_id))
        if odd.any():
            # strings of added tokens stay whole: cut only where one space stands before a non-space
            cut = [_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            begins = np.cumsum([0, *map(len, cut)])
            parts.append(self._encode(pa.array([p.encode() for c in cut for p in c], pa.large_binary()), begins, end_id))
        if len(parts) == 1:
            return parts[0]
        sizes = np.empty(len(texts), np.int64)
        sizes[~odd], sizes[odd] = parts[0][1], parts[1][1]
        owner = np.repeat(odd, sizes)
        out = np.empty(len(owner), np.uint32)
        out[~owner], out[owner] = parts[0][0], parts[1][0]
        return out, sizes


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts, none null, one after the other, and where each text ends."""
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets[1:] - offsets[0]


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


def _write_rows(batches, folder: str, tokenizer: str, end_id: int, placed: bool):
    """One file for the rows of a task, or, with ``placed``, one for each run of rows that follow each other in a stored file."""
    from pyspark import TaskContext

    encoders = worker_cache(ENCODERS)
    if tokenizer not in encoders:
        encoders[tokenizer] = PieceEncoder(tokenizer)
    encoder = encoders[tokenizer]
    files, base = _filesystem(folder)
    files.create_dir(base, recursive=True)
    task = TaskContext.get().partitionId()
    writer, place, following = None, None, None

    def finished():
        documents, ids = writer.finish()
        writer.sink.close()
        name = f"part-{place[0]:012d}-{place[1]:012d}.pfor"
        files.move(draft, f"{base}/{name}")  # every attempt writes the same bytes
        values = (place[0], place[1], f"{folder}/{name}", documents, ids)
        return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("part", "first", "path", "documents", "ids"), values)}, _FILES)

    for batch in slices(batches, step=1 << 21):
        begins = [0]
        if placed:
            file, row = batch.column("_part").to_numpy(), batch.column("_row").to_numpy()
            begins += (np.flatnonzero((np.diff(file) != 0) | (np.diff(row) != 1)) + 1).tolist()
        for begin, end in zip(begins, [*begins[1:], batch.num_rows]):
            here = (int(file[begin]), int(row[begin])) if placed else (task, 0)
            if writer is None or placed and here != following:
                if writer is not None:
                    yield finished()
                place, draft = here, f"{base}/.draft-{uuid.uuid4().hex}"
                writer = FileWriter(files.open_output_stream(draft))
            part = batch.slice(begin, end - begin)
            following = (here[0], here[1] + end - begin)
            ids, sizes = encoder.encode(pc.fill_null(part.column("text"), ""), end_id)
            writer.add(part.column("doc_id").fill_null(NO_ID).to_numpy(), sizes, ids)
    if writer is not None:
        yield finished()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, order: list[str] | None = None, end_id: int = END_ID, placed: bool = False) -> DataFrame:
    """Write token files below ``folder``; one row per file: ``part``, ``first``, ``path``, ``documents``, ``ids``, ``start``.

    Files follow each other in the order of the columns ``order`` (default
    ``doc_id``, equal ids by text, null first). With ``placed`` the rows stay where they are: they
    come from stored files, and the whole numbers ``_part`` and ``_row`` tell the file and the row in it.
    A null text gives the end id alone. ``start`` is the number of ids in the files before. No documents, no files.
    """
    doc, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    if placed:
        ranged = docs.select(doc, text, F.col("_part").cast("long").alias("_part"), F.col("_row").cast("long").alias("_row"))
    elif order:
        ranged = docs.select(doc, text, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
        by = [f"_o{i}" for i in range(len(order))]
        ranged = ranged.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    else:
        # ranges by the id alone: limits are sampled on the driver, which texts must not reach
        ranged = docs.select(doc, text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    run = partial(_write_rows, folder=folder, tokenizer=tokenizer, end_id=end_id, placed=placed)
    manifest = f"{folder}/_manifest"
    ranged.mapInArrow(run, "part long, first long, path string, documents long, ids long").write.parquet(manifest)
    files = docs.sparkSession.read.parquet(manifest)
    before = F.sum("ids").over(W.orderBy("part", "first").rowsBetween(W.unboundedPreceding, -1))  # one row per file
    return files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def _read_rows(batches):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            files, base = _filesystem(path)
            with files.open_input_file(base) as source:
                file = TokenFile(source)
                firsts = np.concatenate([[0], file.ends[:-1]])
                doc = 0
                while doc < len(file.ends):  # about a million ids at a time
                    last = max(doc + 1, int(np.searchsorted(file.ends, firsts[doc] + (1 << 20), "right")))
                    ids = file.ids(int(firsts[doc]), int(file.ends[last - 1])).astype("<u4")
                    here = slice(doc, last)
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip((firsts[here] - firsts[doc]).tolist(), (file.ends[here] - firsts[doc]).tolist())]
                    names = file.doc_ids[here]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, mask=names == NO_ID), pa.array(firsts[here] + start), pa.array(file.ends[here] - firsts[here]), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    doc = last


def read_index(files: DataFrame) -> DataFrame:
    """One row per document of some files (as :func:`write_tokens` returns them), from the files themselves.

    ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, and
    ``ids_crc32`` of the unpacked ids.
    """
    rows = files.select("path", "start").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4))
    return rows.mapInArrow(_read_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer: str, order: list[str] | None = None, placed: bool = False) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    return read_index(write_tokens(docs, run_dir(docs.sparkSession, "tokens"), tokenizer, order, placed=placed))


__all__ = ["FileWriter", "PieceEncoder", "TokenFile", "decode_blocks", "encode_blocks", "read_index", "token_index", "write_tokens"]
