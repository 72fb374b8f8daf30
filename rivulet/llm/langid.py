"""Language identification by compression with per-language zstandard dictionaries.

``fit`` takes a bounded, deterministic sample of labelled rows of each language (``ROWS`` rows, those
with the smallest hash, and of each ``ROW_CHARS`` characters in a row from a place that its hash chooses) and joins it to one raw-content
dictionary per language. ``identify`` encodes every whole text, in blocks of ``BLOCK`` bytes that
each start afresh from the dictionary, once per language; the language with the fewest bytes wins.
The margin is the share of the runner-up's bytes that the winner saves. Where it is narrow the row is
not ``accepted``; the best guess stays in ``lang_pred``. The sample's size doesn't depend on the
input's, so the dictionaries that go to the tasks have a fixed bound; texts are not shuffled.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and not accepted; rows
whose language or text is null teach nothing; without any teaching row all rows are ``und``; ties
go to the alphabetically first language and have margin 0; repeated rows get the same answer; extra
columns pass through and columns with the names of the outputs are replaced.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, returned, smallest_by_class, split_of

NAME = "op2_langid"
ORACLE_SQL = None

#: Bounds of the fitted sample: rows of a language, and characters of a row.
ROWS, ROW_CHARS = 240, 500
#: Bytes encoded at once.
BLOCK = 512
#: zstandard's level: lower ones find too few matches in short blocks, higher ones gain nothing.
LEVEL = 5
#: Rows whose margin is below this are not accepted.
MARGIN = 0.005


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> dict[str, bytes]:
    """Dictionary of each language; learns from all rows of ``df`` that have text and language."""
    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    sample = (
        smallest_by_class(known, "lang", rows)
        .withColumn("start", F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - ROW_CHARS, F.lit(0)) + 1).cast("int") + 1)
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.col("text").substr(F.col("start"), F.lit(ROW_CHARS)))).alias("texts"))
    )
    return {r.lang: _letters(" ".join(r.texts)) for r in sample.collect()}


@functools.lru_cache(maxsize=1)
def _other():
    import regex

    return regex.compile(r"[^\p{L}\p{M}]+")


def _letters(text: str) -> bytes:
    return _other().sub(" ", text.lower()).encode()


def identify(df: DataFrame, model: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``df`` with lang_pred, score (0 to 1), margin (0 to 1) and accepted."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    names = {f.name for f in added}
    passed = [f for f in df.schema.fields if f.name.lower() not in names]
    langs = sorted(model)

    def run(batches):
        import regex
        import zstandard

        letter = regex.compile(r"\p{L}").search
        encoders = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

        def judge(text):
            if not langs or not text or not letter(text):
                return "und", 0.0, 0.0, False
            raw = _letters(text)
            blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
            sizes = [sum(map(len, map(encode, blocks))) for encode in encoders]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            if len(sizes) == 1:
                return langs[0], 1.0, 1.0, True
            second = min(s for i, s in enumerate(sizes) if i != best)
            won = (second - sizes[best]) / second
            score = 1 - (1 - 1 / len(langs)) * 2.0 ** -min(60, second - sizes[best])
            return langs[best], score, won, won >= margin

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = [judge(t.as_py()) for t in texts]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in passed]
            cols = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*own, *cols], names=[*(f.name for f in passed), *(f.name for f in added)])

    return df.mapInArrow(returned(run), T.StructType([*passed, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(split_of("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")
