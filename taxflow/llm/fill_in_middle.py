"""Fill-in-the-middle transformation of documents.

A document is cut at two ranks of its tokens.  An indexable skip list finds the
code points of both cuts: every link knows how many tokens and how many code
points it spans, so a descent that adds up widths ends exactly at the rank.
Texts stay in the JVM; Python returns three numbers for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxflow.llm.kernels import IS_SPACE, Words, mix, slices, utf8
from taxflow.llm.text import fresh

# The marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42"
#: A node of a lane is in the next one with probability 1 / 4.
SPREAD_BITS = 2


class SkipList:
    """Tokens by rank.  ``widths``: the code points of each token.

    ``lanes[0]`` has a link for each token; each further lane skips to about
    every fourth node of the one below.  A lane is (down, units, chars): for
    each link the place of its first node in the lane below, and its widths.
    """

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        node = np.arange(n)
        height = mix(node.astype(np.uint64) + np.uint64(1))  # its low bits decide how high a node stands
        self.lanes = [(node, np.ones(n, dtype=np.int64), widths)]
        bits = SPREAD_BITS
        while len(node) > 1:
            up = (height[node] & np.uint64((1 << bits) - 1)) == 0
            up[0] = True  # all lanes begin at the head
            down = np.flatnonzero(up)
            if len(down) == len(node) or bits > 60:
                break
            _, units, chars = self.lanes[-1]
            self.lanes.append((down, np.add.reduceat(units, down), np.add.reduceat(chars, down)))
            node = node[down]
            bits += SPREAD_BITS

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` tokens."""
        at, units_done, chars_done = 0, 0, 0
        for k in range(len(self.lanes) - 1, -1, -1):
            down, units, chars = self.lanes[k]
            while at < len(units) and units_done + units[at] <= rank:
                units_done += units[at]
                chars_done += chars[at]
                at += 1
            if units_done == rank:
                break
            at = down[at]
        return int(chars_done)


def token_widths(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text of a slice the code points of its tokens.

    A token is a word with the white space before it; white space at the end is one of its own.
    """
    words = Words(data, offsets)
    base = int(offsets[0])
    starts = np.zeros(len(words.data) + 1, dtype=np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=starts[1:])  # code points that begin before a byte
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]) - base, int(offsets[i + 1]) - base
        ends = words.end[words.first[i] : words.first[i + 1]]
        if hi > lo and IS_SPACE[words.data[hi - 1]]:
            ends = np.append(ends, hi)
        yield np.diff(starts[ends], prepend=starts[lo])


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")]))
def cuts(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of tokens, and the code points before the smaller and the larger of the ranks a % (n + 1) and b % (n + 1)."""
    data, offsets = utf8(texts)
    a, b = a.to_numpy(), b.to_numpy()
    out = np.zeros((3, len(texts)), dtype=np.int64)
    row = 0
    for lo, hi in slices(offsets):
        for widths in token_widths(data, offsets[lo : hi + 1]):
            n = len(widths)
            if n:
                tokens = SkipList(widths)
                ranks = sorted((int(a[row]) % (n + 1), int(b[row]) % (n + 1)))
                out[:, row] = n, tokens.chars_before(ranks[0]), tokens.chars_before(ranks[1])
            row += 1
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "first", "second"])


def _draw(key: Column, k: int) -> Column:
    """The k-th group of eight hex digits of the document's hash, as an unsigned integer."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    ``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of these
    with the suffix first.  ``output``: plain, the text; psm, prefix, suffix,
    middle; spm, suffix, prefix, middle, each after its mark.  Texts with a
    mark, and empty or null ones (output ""), stay plain.

    What is drawn depends on the id alone, so rows with equal id and text give
    equal results; a null id is drawn as an empty one.  Every row gives one
    row, texts of any length are cut whole, and other columns stay: of those
    named as a result, the result replaces the column.
    """
    text, key = F.coalesce(F.col(text_column), F.lit("")), F.col(id_column)
    text_, found_, form_ = fresh(docs, "text", "found", "form")
    found = docs.withColumn(text_, text).withColumn(found_, cuts(F.col(text_), _draw(key, 0), _draw(key, 1)))
    text = F.col(text_)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (_draw(key, 2) % 100 >= rate), "plain").when(_draw(key, 3) % 100 < spm_rate, "spm").otherwise("psm")
    found = found.withColumn(form_, form)
    n, a, b = (F.col(f"{found_}.{x}") for x in ("n", "first", "second"))
    prefix, middle, suffix = F.substring(text, F.lit(1), a.cast("int")), F.substring(text, (a + 1).cast("int"), (b - a).cast("int")), F.substring(text, (b + 1).cast("int"), F.length(text))
    form, cut = F.col(form_), F.col(form_) != "plain"
    output = F.when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text)
    given = {"n": n, "form": form, "prefix_chars": F.when(cut, a), "middle_chars": F.when(cut, b - a), "output": output}
    taken = {c.lower() for c in (*given, text_, found_, form_)}
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken], *[c.alias(name) for name, c in given.items()])


def restored(output: Column, form: Column) -> Column:
    """The text of which ``fill_in_middle`` made ``output``; each mark is in it once."""
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    last = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: The query's SQL.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  [('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * k + 1, 8))::BIGINT for k in [0, 1, 2, 3]] AS h FROM documents),
c AS (SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1:b], ''), '') AS middle, coalesce(array_to_string(w[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
