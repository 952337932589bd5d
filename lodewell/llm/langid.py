"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of its own text. A text is compressed against
every dictionary, block by block and to its end, and takes the language of the smallest total. Where the
best two totals lie close together the decision is marked as rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.llm.worker import give_back

UNDETERMINED = "und"

# Everything in ASCII that is not a letter becomes a space.
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))

_RESULT = "lang string, score double, margin double, rejected boolean"


def normalize(text: str) -> bytes:
    """Lower-cased UTF-8 in which digits and ASCII punctuation are single or repeated spaces."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, the language with most labelled rows first, and how to compress with them.

    A decision is rejected if the runner-up needs less than `min_margin` more bytes, as a share.
    """

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 6
    block_bytes: int = 4096
    lead_bytes: int = 512
    min_margin: float = 0.002

    def scorer(self) -> Scorer:
        return Scorer(self)


def _reaching(content: bytes, level: int) -> zstandard.ZstdCompressionParameters:
    """The settings of a level, with tables large enough that every part of a dictionary is indexed.

    Those of the level index a bounded part at its end, and would leave the rest of a larger dictionary without use.
    """
    own = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content))
    log = max(10, len(content).bit_length())
    return zstandard.ZstdCompressionParameters(
        compression_level=level, window_log=max(own.window_log, log), hash_log=max(own.hash_log, log), chain_log=max(own.chain_log, log),
        search_log=own.search_log, min_match=own.min_match, strategy=own.strategy,
    )


class Scorer:
    """The compressors of one task."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.languages = [lang for lang, _ in model.dictionaries]
        self.compressors, self.leads = [], []
        for _, content in model.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=_reaching(content, model.level))
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=model.level,
                    dict_data=dictionary,
                    write_content_size=False,
                    write_checksum=False,
                    write_dict_id=False,
                )
            )
            # zstandard stores tiny inputs raw, which would make every size equal. A lead that is in the
            # dictionary, and so costs one match, keeps the block compressible; its own size is taken off.
            lead = content[-model.lead_bytes :]
            self.leads.append((lead, len(self.compressors[-1].compress(lead))))

    def sizes(self, text: str) -> np.ndarray:
        data, step = normalize(text), self.model.block_bytes
        totals = [0] * len(self.compressors)
        for start in range(0, len(data), step):
            block = data[start : start + step]
            for k, compressor in enumerate(self.compressors):
                if len(block) >= self.model.lead_bytes:
                    totals[k] += len(compressor.compress(block))
                else:
                    lead, cost = self.leads[k]
                    totals[k] += len(compressor.compress(lead + block)) - cost
        return np.array(totals, dtype=np.float64)

    def decide(self, text: str | None) -> tuple[str, float, float, bool]:
        if text is None or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0, True
        sizes = self.sizes(text)
        best = int(sizes.argmin())  # the first of equals
        # Sizes are code lengths: a language 2 % longer is e times less likely.
        likelihood = np.exp((sizes[best] - sizes) / (0.02 * sizes[best] + 1.0))
        others = np.delete(sizes, best)
        margin = float((others.min() - sizes[best]) / others.min()) if len(others) else 1.0
        return self.languages[best], float(1.0 / likelihood.sum()), margin, margin < self.model.min_margin


def fit(
    labelled: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    docs_per_language: int = 64,
    bytes_per_language: int = 1 << 20,
    **settings,
) -> LanguageModel:
    """Dictionaries from the whole texts of at most `docs_per_language` rows of each language, short ones included.

    Of each language and hash bucket the row whose key has the least hash is taken, an aggregation that combines
    map-side, so that no language is ever in one task; of rows that share that key the one with the smallest text. In
    the order of that hash, texts go into the dictionary that fit whole within what is left of `bytes_per_language`; if
    none does, the shortest is the dictionary. The two parameters bound the sample, and so what reaches the driver. Rows with null text,
    language or key are not used; no usable rows, as of an empty table, give a model that answers `und` only. Other
    columns may have any name.
    """
    spark = labelled.sparkSession
    hashed = F.xxhash64(F.col(key).cast("string"))
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(
        F.col(lang).cast("string").alias("l"), F.pmod(hashed, F.lit(docs_per_language)).alias("b"), hashed.alias("h"), F.col(text).alias("t")
    )
    chosen = usable.groupBy("l", "b").agg(F.min("h").alias("h"), F.count("*").alias("n")).collect()
    sizes = Counter()
    for r in chosen:
        sizes[r["l"]] += r["n"]
    wanted = F.broadcast(spark.createDataFrame([(r["l"], r["h"]) for r in chosen], "l string, h long"))  # a row a bucket
    picked = usable.join(wanted, ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t"))
    taken, left, shortest = [], {}, {}
    for r in sorted(picked.select("l", "h", F.octet_length("t").alias("n")).collect(), key=lambda r: (r["l"], r["h"])):  # lengths alone
        left.setdefault(r["l"], bytes_per_language)
        shortest[r["l"]] = min(shortest.get(r["l"], (r["n"], r["h"])), (r["n"], r["h"]))
        if r["n"] <= left[r["l"]]:
            left[r["l"]] -= r["n"]
            taken.append((r["l"], r["h"]))
    taken += [(name, shortest[name][1]) for name in sorted(shortest) if left[name] == bytes_per_language and (name, shortest[name][1]) not in taken]
    rows = picked.join(F.broadcast(spark.createDataFrame(taken, "l string, h long")), ["l", "h"]).collect() if taken else []
    parts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["l"], r["h"])):
        parts.setdefault(r["l"], []).append(normalize(r["t"]))
    names = sorted(parts, key=lambda name: (-sizes[name], name))
    return LanguageModel(tuple((name, b" ".join(parts[name])) for name in names), **settings)


def language(model: LanguageModel, text: Column | str) -> Column:
    """struct<lang, score, margin, rejected> of a whole text.

    A text that is null, empty or without any letter is `und`, score 0 and rejected. Equal sizes give the
    language with most labelled rows, margin 0 and so a rejection. Very long texts are compressed in blocks.
    """

    @F.pandas_udf(_RESULT)
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.DataFrame(
                [scorer.decide(t) for t in texts], columns=["lang", "score", "margin", "rejected"]
            )
        del scorer
        give_back()

    return decide.asNondeterministic()(text)  # else the optimizer may run it twice


def held_out(key: Column | str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key, as text, leaves `fold` modulo `folds`; a null key is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(folds)) == fold, F.lit(True))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of `docs`, repeated rows included: key, lang_pred, score, margin, rejected.

    Null, empty and letterless texts are `und`; texts of any length are read whole. Rows with a null key are judged
    like others, an empty table gives no rows, and other columns, whatever their names, are left out.
    """
    out = docs.select(F.col(key).alias("k"), language(model, F.col(text)).alias("d"))
    return out.select(F.col("k").alias(key), F.col("d.lang").alias("lang_pred"), "d.score", "d.margin", "d.rejected")
