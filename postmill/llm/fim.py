"""Fill-in-middle by a piece table.

A text is never copied while it is cut and rearranged. A document is a list of descriptors (buffer, start,
length) over two immutable buffers: its own UTF-8 bytes and the three sentinels. Cutting splits a descriptor,
an arrangement permutes the descriptors, and the inverse permutation restores the text. Digests are streamed
over the descriptors.

Units are words with the white space before them; white space at the end of a text is a unit of its own. The
two cuts, whether a text is rearranged and which way are drawn from a hash of seed and id, so reruns agree.

Null and empty texts are left as they are (form ``plain``, output empty), as are texts that hold a sentinel. A
null id hashes as an empty one; rows of one id are drawn alike. Result columns replace input columns of the
same name. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import bytes_of, map_text, slices

#: The sentinels of prefix, suffix and middle, and the buffer that holds them.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
MARK_BUFFER = b"".join(MARKS.values())
#: Order of the parts after their sentinels in each form. The middle comes last, where it is learned.
FORMS = {"psm": "PSM", "spm": "SPM"}
TEXT, MARK = 0, 1
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

Piece = tuple[int, int, int]


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The pieces with one more border ``at`` bytes from their start; the piece there is split, maybe into an empty one."""
    out, before = [], 0
    for i, (buffer, start, length) in enumerate(pieces):
        if at <= before + length:
            left = at - before
            return [*out, (buffer, start, left), (buffer, start + left, length - left), *pieces[i + 1 :]]
        out.append((buffer, start, length))
        before += length
    raise ValueError("cut beyond the end")


def arrange(pieces: list[Piece], form: str) -> list[Piece]:
    """The output's pieces of a text cut into prefix, middle and suffix."""
    if form == "plain":
        return pieces
    of = dict(zip("PMS", pieces, strict=True))
    marks = list(MARKS)
    return [p for k in FORMS[form] for p in ((MARK, 3 * marks.index(k), 3), of[k])]


def locate(output: bytes, form: str) -> list[Piece] | None:
    """The parts of an output in the order in which they stand in it; None where the sentinels are not as the form wants them."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    if form not in FORMS:
        return None
    starts, at = [], 0
    for k in FORMS[form]:
        found = output.find(MARKS[k], at)
        if found < 0 or (not starts and found):
            return None
        starts.append(found)
        at = found + 3
    ends = [*starts[1:], len(output)]
    return [(TEXT, s + 3, e - s - 3) for s, e in zip(starts, ends, strict=True)]


def inverse(pieces: list[Piece], form: str) -> list[Piece]:
    """The pieces of the text again: prefix, middle, suffix."""
    return pieces if form == "plain" else [pieces[FORMS[form].index(k)] for k in "PMS"]


def stream(pieces: Iterable[Piece], text: bytes) -> Iterator[memoryview]:
    buffers = (memoryview(text), memoryview(MARK_BUFFER))
    for buffer, start, length in pieces:
        yield buffers[buffer][start : start + length]


def digest(pieces: Iterable[Piece], text: bytes) -> str:
    """Lower-case hex SHA-256 over the pieces, without joining them."""
    h = hashlib.sha256()
    for part in stream(pieces, text):
        h.update(part)
    return h.hexdigest()


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of units of each row; ends of all words, and where each row's begin among them."""
    white = WHITE[data]
    last = np.ones(len(data), bool)
    last[:-1] = white[1:]
    full = offsets[1:] > offsets[:-1]
    last[offsets[1:][full] - 1] = True
    ends = np.flatnonzero(last & ~white) + 1
    begin = np.searchsorted(ends, offsets, "right")
    n = np.diff(begin)
    tail = np.zeros(len(n), np.int64)
    tail[full] = white[offsets[1:][full] - 1]
    return n + tail, ends, begin[:-1]


def transform(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, seed: str = "42", rate: int = 50, spm: int = 80
) -> DataFrame:
    """``keep`` columns with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (null if
    plain), ``pieces`` (the output's descriptors; buffer 0 the text's bytes, 1 the sentinels), ``output`` and its
    ``output_sha256``.

    ``rate`` of 100 texts are rearranged, ``spm`` of 100 of these with the suffix first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T._parse_datatype_string(
        "n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, output string, output_sha256 string"
    )
    keep = [k for k in (docs.columns if keep is None else keep) if k not in new.names]
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    # own names inside, so that no kept column can clash
    rows = docs.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keep)], hashed.alias("_drawn"), F.col(f"`{text}`").cast("string").alias("_text_in"))
    kept = [T.StructField(k, f.dataType) for k, f in zip(keep, rows.schema.fields, strict=False)]
    schema = T.StructType([*kept, *new.fields])
    arrow = to_arrow_schema(new)

    def chars(lead: np.ndarray, a: int, b: int) -> int:
        return int(np.count_nonzero(lead[a:b]))

    def work(drawn: list[str], column: pa.Array) -> list[list]:
        data, offsets = bytes_of(column)
        n, ends, begin = units(data, offsets)
        words = np.diff(np.append(begin, len(ends)))
        lead = (data & 0xC0) != 0x80
        out: list[list] = [[] for _ in new]
        for i, d in enumerate(drawn):
            h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
            start, size, count = int(offsets[i]), int(offsets[i + 1] - offsets[i]), int(n[i])
            body = data[start : start + size].tobytes()
            pieces: list[Piece] = [(TEXT, 0, size)]
            if not size or h[2] % 100 >= rate or any(m in body for m in MARKS.values()):
                form, prefix, middle = "plain", None, None
            else:
                form = "spm" if h[3] % 100 < spm else "psm"
                bounds = []
                for k in sorted((h[0] % (count + 1), h[1] % (count + 1))):
                    bounds.append(0 if k == 0 else int(ends[begin[i] + k - 1]) - start if k <= words[i] else size)
                pieces = cut(cut(pieces, bounds[0]), bounds[1])
                prefix, middle = chars(lead, start, start + bounds[0]), chars(lead, start + bounds[0], start + bounds[1])
            pieces = arrange(pieces, form)
            listed = [{"buffer": b, "start": s, "length": z} for b, s, z in pieces]
            for made, value in zip(out, (count, form, prefix, middle, listed, b"".join(stream(pieces, body)), digest(pieces, body)), strict=True):
                made.append(value)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text_in"):
                made = work(part.column("_drawn").to_pylist(), part.column("_text_in"))
                arrays = [pa.array(a, pa.binary()).cast(f.type) if f.name == "output" else pa.array(a, f.type) for a, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


def restore(rows: DataFrame, output: str = "output", form: str = "form", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``restored``, the text again, and ``restored_sha256``, from output and form alone.

    Both are null where the output lacks the sentinels that its form has, or the form is unknown.
    """
    # the form rides in front of the output, as a mapped text is one column
    packed = F.concat(F.coalesce(F.col(f"`{form}`"), F.lit("")), F.lit("\n"), F.coalesce(F.col(f"`{output}`"), F.lit("")))
    keep = rows.columns if keep is None else keep
    packed_rows = rows.select(*[F.col(f"`{k}`") for k in keep], packed.alias("_packed"))

    def make():
        def work(column: pa.Array) -> list:
            data, offsets = bytes_of(column)
            texts, digests = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                name, _, body = data[a:b].tobytes().partition(b"\n")
                name = name.decode()
                pieces = locate(body, name)
                pieces = None if pieces is None else inverse(pieces, name)
                texts.append(None if pieces is None else b"".join(stream(pieces, body)))
                digests.append(None if pieces is None else digest(pieces, body))
            return [pa.array(texts, pa.binary()).cast(pa.string()), digests]

        return work

    return map_text(packed_rows, "_packed", keep, "restored string, restored_sha256 string", make)
