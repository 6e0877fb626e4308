"""Fill-in-middle transformation of whole texts, and its inverse.

A text is cut into prefix, middle and suffix at two of its unit borders; a unit is a code point. The borders are found
on 64-bit words: the UTF-8 bytes of an Arrow batch are viewed as uint64, the bytes that end a unit are marked
by word arithmetic (SWAR), ``bitwise_count`` counts the marks of each word, a search in the cumulative counts names the word
that holds the wanted mark, and prefix sums within that word give its byte. No character is decoded.

Cut points and forms come from a hash of the document id, so a rerun, or another order of rows, gives the same output.
``restored`` rebuilds the text from the output and its form alone.

Cases: a null text counts as empty; empty texts, and texts that hold one of the three marks themselves, stay
plain; a null id is hashed as an empty string; repeated rows give repeated rows; rows of equal text but other ids are cut
elsewhere; a text of any length is handled whole (an Arrow batch ends at 8 MB, a longer text is a batch alone);
bytes that are not UTF-8 count with the unit before them; without rows there are no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import query, small_batches, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"
_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
_COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def hashed(seed: str, doc_id: Column, group: int) -> Column:
    """The ``group``-th 8 hexadecimal digits of the id's hash as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Words with bit 0 of every byte set that ends a unit: bytes not followed by a continuation byte (10xxxxxx).

    ``data`` is padded with spaces to one word more than it fills; the last byte of the data ends a unit.
    """
    padded = np.full(len(data) // 8 * 8 + 16, 0x20, np.uint8)
    padded[:len(data)] = data
    words = padded.view("<u8")
    continued = (words >> np.uint64(7)) & ~(words >> np.uint64(6)) & _ONES
    starts = continued ^ _ONES
    return (starts[:-1] >> np.uint64(8)) | (starts[1:] << np.uint64(56))


class Ends:
    """The unit-ending bytes of a buffer of texts: counts up to a byte and the place of the k-th."""

    def __init__(self, data: np.ndarray, borders: np.ndarray) -> None:
        self.words = unit_ends(data)
        last = borders[borders > 0] - 1  # a text ends a unit whatever follows it
        self.words.view(np.uint8)[last] = 1
        self.upto = np.r_[np.int64(0), np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def before(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        held = self.words[word] & ~(np.uint64(0xFFFFFFFFFFFFFFFF) << (byte * np.uint64(8)))
        return self.upto[word] + np.bitwise_count(held)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The place after the byte of the k-th mark (from 1); 0 for the 0-th."""
        word = np.searchsorted(self.upto, k, side="left") - 1
        left = (k - self.upto[np.maximum(word, 0)]).astype(np.uint64)
        sums = self.words[np.maximum(word, 0)] * _ONES  # byte j: marks in bytes 0 to j
        enough = ((sums | _TOPS) - left * _ONES) & _TOPS  # byte j: whether these are the wanted number
        return np.where(k > 0, 8 * word + 9 - np.bitwise_count(enough), 0)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the borders of its texts in them."""
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    borders = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[borders[0]:borders[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, borders - borders[0]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, first, second, form) to rows of _COLUMNS."""
    marks = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
    marks = {form: tuple(m.encode() for m in three) for form, three in marks.items()}
    for batch in batches:
        if not batch.num_rows:
            continue
        data, borders = _bytes_of(batch.column(1))
        ends = Ends(data, borders)
        upto = ends.before(borders)
        n = np.diff(upto)
        first, second = (batch.column(i).to_numpy() % (n + 1) for i in (2, 3))
        low, high = np.minimum(first, second), np.maximum(first, second)
        # a cut after no unit of a text is the text's start, which may lie behind empty texts: not the end of the unit before
        a = np.where(low > 0, ends.after(upto[:-1] + low), borders[:-1])
        b = np.where(high > 0, ends.after(upto[:-1] + high), borders[:-1])
        view, out, ended = memoryview(data), [], [0]
        forms = batch.column(4).to_pylist()
        for form, start, x, y, end in zip(forms, borders[:-1].tolist(), a.tolist(), b.tolist(), borders[1:].tolist(), strict=True):
            if form == PLAIN:
                out.append(view[start:end])
                ended.append(ended[-1] + end - start)
                continue
            one, two, three = marks[form]
            prefix, middle, suffix = view[start:x], view[x:y], view[y:end]
            out += (one, prefix, two, suffix, three, middle) if form == PSM else (one, suffix, two, prefix, three, middle)
            ended.append(ended[-1] + end - start + len(one) + len(two) + len(three))
        text = pa.LargeStringArray.from_buffers(len(forms), pa.py_buffer(np.array(ended, np.int64)), pa.py_buffer(b"".join(out)))
        plain = np.array([form == PLAIN for form in forms])
        columns = [batch.column(0), pa.array(n), batch.column(4), pa.array(low, mask=plain), pa.array(high - low, mask=plain), text]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES, strict=True)],
                                         names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transformed(docs: DataFrame, seed: str = "1", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of ``docs(doc_id, text)``.

    ``plain_percent`` of the documents stay as they are; of the others ``spm_percent`` put the suffix first.
    """
    text = F.coalesce("text", F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    group = [hashed(seed, F.col("doc_id"), i) for i in (1, 2, 3, 4)]
    form = F.when((text == "") | marked | (group[2] % 100 >= 100 - plain_percent), PLAIN).when(group[3] % 100 < spm_percent, SPM).otherwise(PSM)
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), group[0].alias("first"), group[1].alias("second"), form.alias("form"))
    return small_batches(rows).mapInArrow(_cut, _COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text that gave ``output``. Outside plain rows no text holds a mark, so the three marks cut it exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, three = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == PSM, F.concat(one, three, two)).when(form == SPM, F.concat(two, three, one)).otherwise(output)


@query("op11_fill_in_middle", """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM h),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, as digests of the output and of the text restored from it."""
    made = transformed(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
