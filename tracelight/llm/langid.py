"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.llm._common import give_back, small_batches

UNDETERMINED = "und"

#: Bound of the sample: about so many labelled documents a language, and so many bytes of slices of them.
DOCS_PER_LANGUAGE = 250
DICTIONARY_BYTES = 40 << 10
#: Bound of the languages: the most frequent so many labels are learned (ties: by name); others are noise of the labels.
MOST_LANGUAGES = 256
#: Texts are compressed in blocks of so many bytes, so that a long text does not become its own dictionary.
BLOCK_BYTES = 4096
LEVEL = 6
#: Relative margins below this are rejected.
MIN_MARGIN = 0.01
#: Equal sizes are settled by code lengths under contexts of up to so many bytes.
CONTEXT_BYTES = 3


@dataclass(frozen=True)
class LanguageModel:
    dictionaries: dict[str, bytes]


def _prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def fit_languages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Raw-content dictionaries from a bounded sample of labelled rows.

    Per language, rows whose id hash is under a threshold that lets about ``docs_per_language``
    through give one slice each at a hashed place, long enough to fill the dictionary together. Rows without language,
    text or id are not learned from. The sample, not the table, reaches the driver: at most
    ``most_languages`` counts and about as many times ``docs_per_language`` slices."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(most_languages).collect()}
    if not sizes:
        return LanguageModel({})
    spread = 1 << 40
    hashed = F.pmod(F.xxhash64("_id", F.lit("language")), F.lit(spread))
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(spread, 1 + spread * docs_per_language // n))])
    slices_of = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, -(-dictionary_bytes // min(n, docs_per_language)))])
    chars = slices_of[F.col("_lang")]
    room = F.greatest(F.length("_text") - chars, F.lit(0)) + 1
    place = (F.pmod(F.xxhash64("_id", F.lit("place")), room) + 1).cast("int")
    sample = rows.where(hashed < limits[F.col("_lang")]).select("_lang", hashed.alias("_h"), "_id", F.substr("_text", place, chars).alias("_slice"))
    slices: dict[str, list] = {}
    for r in sample.collect():
        slices.setdefault(r["_lang"], []).append((r["_h"], r["_id"], r["_slice"]))
    out = {}
    for lang, found in sorted(slices.items()):
        # the end of a dictionary is the cheapest to refer to: the order is fixed by the hash
        out[lang] = b"\n".join(_prepared(s) for _, _, s in sorted(found))[-dictionary_bytes:] or b" " * 8
    return LanguageModel({k: v.ljust(8, b" ") for k, v in out.items()})


class Coder:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, model: LanguageModel, level: int = LEVEL, block: int = BLOCK_BYTES):
        import zstandard as zstd

        self.block, self.coders = block, {}
        for lang, content in model.dictionaries.items():
            raw = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.coders[lang] = zstd.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, text: str) -> dict[str, int]:
        raw = _prepared(text)
        step = max(1, -(-len(raw) // max(1, round(len(raw) / self.block))))
        blocks = [raw[i : i + step] for i in range(0, len(raw), step)]
        return {lang: sum([len(code(b)) for b in blocks]) for lang, code in self.coders.items()}


class ContextCoder:
    """Ideal code lengths in bits of a text under byte contexts counted in each language's dictionary.

    The probability of a byte blends all contexts up to ``order`` bytes, each weighted against the
    next shorter by the number of bytes seen after it (Witten and Bell's escape). Unlike compressed
    sizes, the lengths are not whole bytes, so texts of a few words have a measurable margin."""

    def __init__(self, model: LanguageModel, order: int = CONTEXT_BYTES):
        self.order, self.dictionaries, self.tables = order, model.dictionaries, {}

    def _table(self, lang: str):
        """Counts of strings of up to order + 1 bytes, and per context its occurrences and distinct next bytes."""
        if lang not in self.tables:
            content = self.dictionaries[lang]
            counts = Counter(content[i : i + n] for n in range(1, self.order + 2) for i in range(len(content) - n + 1))
            contexts = {}
            for found, n in counts.items():
                seen, kinds = contexts.get(found[:-1], (0, 0))
                contexts[found[:-1]] = (seen + n, kinds + 1)
            self.tables[lang] = counts, contexts
        return self.tables[lang]

    def bits(self, text: str, lang: str) -> float:
        counts, contexts = self._table(lang)
        raw, total = b" " + _prepared(text), 0.0
        for i in range(1, len(raw)):
            p = 1 / 256
            for n in range(min(self.order, i) + 1):
                context = contexts.get(raw[i - n : i])
                if context is None:
                    break
                p = (counts.get(raw[i - n : i + 1], 0) + context[1] * p) / (context[0] + context[1])
            total -= math.log2(p)
        return total


def identify(df: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Input rows with ``lang_pred``, ``score``, ``margin`` and ``rejected`` added.

    The whole text is compressed in blocks under each dictionary; the smallest total wins. Languages
    that tie for it in whole bytes are told apart by ``ContextCoder``. ``margin`` is the part by which
    the runner-up is larger, of the sizes or, after a tie, of the code lengths; ``score`` rises with it
    from 0.5 to 1. Narrow margins (below ``min_margin``) are rejected, but not those of tied texts so
    short that a byte is more than ``min_margin`` of their size: equal sizes say nothing of them. Also
    rejected is ``und``: null texts, texts without a letter, and all texts if nothing was learned. Each
    row is judged alone; all columns of the input are passed through, and nothing is shuffled.
    A column of the input with one of the added names is replaced."""
    small_batches(df.sparkSession)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    names = {f.name for f in added}
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    schema = T.StructType([*source.schema.fields, *added])
    at = source.columns.index(text_col)

    def run(batches):
        coder, finer = Coder(model), ContextCoder(model)
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(start, 512)
                langs, scores, margins, rejected = [], [], [], []
                for text in part.column(at).to_pylist():
                    lang, margin, measured = UNDETERMINED, 0.0, True
                    if text and coder.coders and any(c.isalpha() for c in text):
                        ranked = sorted((n, name) for name, n in coder.sizes(text).items())
                        lang = ranked[0][1]
                        margin = 1.0 if len(ranked) == 1 else (ranked[1][0] - ranked[0][0]) / ranked[1][0]
                        if margin == 0:
                            measured = ranked[0][0] * min_margin >= 1
                            ranked = sorted((finer.bits(text, name), name) for n, name in ranked if n == ranked[0][0])
                            lang = ranked[0][1]
                            margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
                    langs.append(lang)
                    margins.append(margin)
                    scores.append(0.0 if lang == UNDETERMINED else 1 - 0.5 * 2 ** (-margin / min_margin))
                    rejected.append(lang == UNDETERMINED or (measured and margin < min_margin))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.fieldNames())

    return source.mapInArrow(give_back(run), schema)
