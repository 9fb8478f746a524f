"""Language identification by compression with per-language zstandard dictionaries.

A raw-content dictionary is gathered for every language from a bounded sample of
labelled texts. A text is encoded once with each dictionary; the language that gives the
fewest bytes is chosen, and the relative margin to the second best is the
score. A narrow margin rejects the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled texts sampled per language, characters taken of each, and bytes of a dictionary at most.
SAMPLE_TEXTS = 512
SAMPLE_CHARS = 4000
DICT_BYTES = 1 << 19
#: Bytes that are compressed at a time: long texts keep meeting the dictionary.
CHUNK = 2048
LEVEL = 6
#: Relative margins below this are rejected.
MIN_MARGIN = 0.004
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_NOT_TEXT = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    """Lower case, every run of other characters than letters as one blank."""
    return _NOT_TEXT.sub(" ", text.lower()).encode("utf-8", "replace")


def fit_dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS,
                     sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """{language: dictionary} from at most ``sample_texts`` labelled texts of each language.

    The sample takes the least hash in each of sample_texts hash cells of a language: it does
    not depend on partitions, and only hashes are aggregated over all rows. Rows
    without a label or text are left out. The driver gets at most
    sample_texts * sample_chars characters a language.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")) \
        .filter("lang is not null and text rlike '\\\\p{L}'").withColumn("h", F.xxhash64("text"))
    picked = rows.groupBy("lang", F.pmod("h", F.lit(sample_texts)).alias("cell")).agg(F.min("h").alias("h"))
    sample = rows.join(F.broadcast(picked.select("lang", "h")), ["lang", "h"]) \
        .select("lang", "h", F.substring("text", 1, sample_chars).alias("text")).dropDuplicates(["lang", "h"])
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.collect():
        parts.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = {}
    for lang, texts in sorted(parts.items()):
        share = max(1, dict_bytes // len(texts))
        out[lang] = b" ".join(normalise(t)[:share] for _, t in sorted(texts))[:dict_bytes]
    return out


def _compressors(dictionaries: dict[str, bytes], level: int):
    import zstandard
    out = []
    for lang, data in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, compressors: list) -> tuple[str, float]:
    """(language, score) of one text; score = 1 - best size / second best size."""
    if text is None or not compressors or not _LETTER.search(text):
        return UNKNOWN, 0.0
    data = normalise(text)
    chunks = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]
    sizes = sorted((sum(len(c.compress(x)) for x in chunks), lang) for lang, c in compressors)
    best, lang = sizes[0]
    second = sizes[1][0] if len(sizes) > 1 else max(best, len(data))
    return lang, 1.0 - best / second


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", level: int = LEVEL,
            min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted (score >= min_margin and not ``und``).

    Columns of these names are replaced; all others pass unchanged and none but the text is
    an input. Null texts and texts without a letter, and every text if no language
    was learned, get ``und``, 0 and not accepted. Whole texts are encoded, in chunks of CHUNK
    bytes. Equal sizes go to the first language by name with score 0. With a single
    language the score compares with the text's plain size.
    """
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.arrow_udf("lang string, score double")  # of Arrow: a task needs no pandas and holds one text in Python at a time
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        comp = _compressors(model.value, level)
        for col in texts:
            langs, scores = [], []
            for t in col:
                lang, score = classify(t.as_py(), comp)
                langs.append(lang)
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    docs = docs.drop("lang_pred", "score", "accepted", "lang_id_result")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.withColumn("lang_id_result", run(F.col(f"`{text_col}`").cast("string")))
    return out.select(*cols, F.col("lang_id_result.lang").alias("lang_pred"), F.col("lang_id_result.score").alias("score"),
                      ((F.col("lang_id_result.score") >= min_margin) & (F.col("lang_id_result.lang") != UNKNOWN)).alias("accepted"))
