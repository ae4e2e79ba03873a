"""Raw documents to packed training sequences: language, exact and near duplicates, source mix, packing.

All stages take documents as they are: null and empty texts, texts of any length, null ids, rows repeated
with one id, an empty table, and further columns, which are left behind. What each makes of them is stated there."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelight.llm import exact_dedup, langid, mixing, near_dedup, packing
from tracelight.llm._common import materialize
from tracelight.llm._common_rows import without_ids
from tracelight.llm.queries import learn_languages

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells with a clear margin.

    Null and empty texts and texts without a letter go, as does every text if no row has a language to
    learn from. Each row is judged alone, so repeated rows and null ids stay or go by their text; null
    languages and sources stay null."""
    return langid.identify(docs.select(*COLUMNS), learn_languages(docs)).where("not rejected").select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of equal texts.

    Texts are read again for full digests only where length and prefix repeat. Null and empty texts are
    one group. Rows repeated with the id that stays all stay (ties); another text of a copy's id stays
    too. Rows with a null id stay."""
    return exact_dedup.without_copies(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id.

    Texts without words are linked with nothing and stay, as do rows with a null id. Rows repeated with
    one id stay or go together, whatever their texts."""
    return without_ids(docs.select(*COLUMNS), near_dedup.near_dedup(docs).where("not kept"), "doc_id")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or the stretches of them, that the mix draws, as often as it draws them.

    A document has no row if nothing of it is drawn; so texts without words (null and empty ones among
    them) go, of which a mix by words can take nothing. A null source is a source, the last. Repeated
    rows and null ids are documents of their own. ``n_chars`` is that of the new text."""
    return mixing.drawn_rows(mixing.mix(docs, carry=COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full training sequences.

    A null or empty text is its end id alone; repeated rows and null ids are packed as documents of
    their own, and a long text becomes whole windows and a rest. An empty table has no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packed)]

#: Compression, sketches and tokenizers are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
