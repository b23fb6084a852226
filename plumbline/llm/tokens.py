"""Public tokenizers, exact token counts of texts of any size, and token totals by source, language and domain.

Counting cuts a text only where the tokenizer's own pattern always ends a token, whatever stands on either side:
between a letter or digit and a following space, line break or mark. Such parts are counted alone and their
counts add up exactly. Texts over OVERSIZED characters are cut into parts that are spread over the
workers by a salt and summed per text again; the rest are counted where they are read.

Null and empty texts hold 0 tokens. Repeated rows are counted as often as they stand in the table.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where the vocabulary files lie; they are never copied.
FOLDER = os.environ.get("PLUMBLINE_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"
OVERSIZED, PART = 65_536, 16_384

# Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: places where that pattern always ends one token and begins another.
LETTERS = "0-9A-Za-zÀ-ÖØ-öø-ÿΑ-ΡΣ-Ωα-ωА-яא-תء-غف-يअ-हक़-ॡก-ะาำเ-ๆぁ-ゖァ-ヺ一-龥가-힣"
BOUNDARY = re.compile(rf"(?<=[{LETTERS}])(?=[ \n.,!?;:()،؟।॥、。，！？「」“”])")
_loaded: dict = {}


def encoder(name: str = DEFAULT, folder: str | None = None):
    """A function from texts to lists of ids, without special tokens; one per worker process."""
    key = (name, folder or FOLDER)
    if key not in _loaded:
        path = os.path.join(key[1], name)
        if os.path.exists(path + ".tiktoken"):
            import tiktoken

            with open(path + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            own = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[key] = lambda texts: [_safe(own, t) for t in texts]
        elif os.path.exists(path + ".json"):
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            t = Tokenizer.from_file(path + ".json")
            t.encode_special_tokens = True
            _loaded[key] = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        elif os.path.exists(path + ".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path + ".model")
            _loaded[key] = lambda texts: sp.encode(texts, num_threads=1)
        else:
            raise FileNotFoundError(f"no vocabulary {name} in {key[1]}")
    return _loaded[key]


def _safe(own, text: str) -> list[int]:
    """Lone surrogates cannot be encoded; they count as the replacement character."""
    try:
        return own.encode_ordinary(text)
    except UnicodeEncodeError:
        return own.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def is_cuttable(name: str) -> bool:
    return name.startswith("byte_bpe")


def parts(text: str, size: int = PART) -> list[str]:
    """The text in parts of at least size characters that end at proven boundaries."""
    out, at = [], 0
    while len(text) - at > size:
        m = BOUNDARY.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


SCRIPTS = {  # fixed values: the letters of one script, and the language most written in it
    "ja": re.compile("[ぁ-ヿ]"), "zh": re.compile("[一-鿿]"), "ko": re.compile("[가-힣]"), "th": re.compile("[ก-๛]"),
    "ar": re.compile("[ء-ي]"), "hi": re.compile("[ऀ-ॿ]"), "ru": re.compile("[А-яЁё]"), "el": re.compile("[Α-ω]"), "he": re.compile("[א-ת]"),
}
#: Labelled documents that the language model is fitted on at most, words kept for each language, and the least share of the sample a language must have.
FITTED, WORDS, LEAST_SHARE = 20_000, 2_000, 0.005
WORD = re.compile(r"[぀-ヿ㐀-鿿가-힣ก-๛]|[^\W\d_]+")


class Languages:
    """Word counts by language as a naive Bayes classifier; by script where no word is known."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.names = sorted(counts)
        kinds = len({w for c in counts.values() for w in c}) or 1
        totals = [sum(counts[k].values()) + 0.5 * kinds for k in self.names]
        self.unknown = [math.log(0.5 / n) for n in totals]
        self.gain: dict[str, list[tuple[int, float]]] = {}
        for i, k in enumerate(self.names):
            for w, n in counts[k].items():
                self.gain.setdefault(w, []).append((i, math.log((n + 0.5) / totals[i]) - self.unknown[i]))

    def of(self, text: str | None) -> str:
        """The most likely language; und if neither words nor script tell. Empty and null texts are und."""
        if not text:
            return "und"
        score, known = [0.0] * len(self.names), 0
        for w, n in Counter(WORD.findall(text.lower())).items():
            if w in self.gain:
                known += n
                for i, g in self.gain[w]:
                    score[i] += n * g
        if not known:
            return by_script(text)
        return self.names[max(range(len(score)), key=lambda i: score[i] + known * self.unknown[i])]


def by_script(text: str) -> str:
    found = {k: len(p.findall(text)) for k, p in SCRIPTS.items()} if not text.isascii() else {}
    if found.get("ja", 0) * 4 >= max(1, found.get("zh", 0)):
        found["ja"] += found["zh"]
    k = max(found, key=found.get, default="")
    return k if k and found[k] * 3 >= len(text) - text.count(" ") else "und"


def _words_by_language(batches):
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(set(WORD.findall(text.lower())))
        rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"]
        )


def fit_languages(documents: DataFrame) -> Languages:
    """Fitted on at most about FITTED documents that state a language; no such documents give a model that goes by scripts alone."""
    labelled = documents.select(
        language(F.col("lang"), F.lit(None).cast("string")).alias("lang"), "text"
    ).where("lang is not null and text is not null and text <> ''")
    have = labelled.count()
    some = labelled.sample(FITTED / have, seed=5) if have > FITTED else labelled
    counts = some.mapInArrow(_words_by_language, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = some.groupBy("lang").agg(F.count("*").alias("rows"))
    kept = [r.lang for r in rows.where(F.col("rows") >= max(2, LEAST_SHARE * min(have, FITTED))).collect()]  # at most 1 / LEAST_SHARE languages
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.where(F.col("lang").isin(kept)).withColumn("rank", rank).where(F.col("rank") <= WORDS).collect()
    found: dict[str, dict[str, int]] = {k: {} for k in kept}
    for r in top:
        found[r.lang][r.word] = r.n
    return Languages(found)


def count_texts(texts: DataFrame, keys: list[str], text_col: str = "text", tokenizer: str = DEFAULT, folder: str | None = None, split_at: str | None = None, languages: Languages | None = None) -> DataFrame:
    """keys, n_tokens, guessed: the exact number of tokens of every row's text, and its language if a model is given. keys must tell the rows apart or be summed over.

    split_at: a string before which texts may be cut too (a line break after a mark), so that what many texts share is counted once per worker.
    """
    spark_types = [f"`{k}` {t}" for k, t in texts.select(*keys).dtypes]
    schema = ", ".join(spark_types) + ", n_tokens long, guessed string"
    source = texts.select(*keys, F.col(text_col).alias("__text"))
    large = F.length("__text") > OVERSIZED if is_cuttable(tokenizer) else F.lit(False)

    shared = texts.sparkSession.sparkContext.broadcast(languages)  # at most WORDS / LEAST_SHARE words

    def count(batches):
        encode = encoder(tokenizer, folder)
        model = shared.value
        memo: dict[str, tuple[int, str]] = {}

        def of(part: str) -> tuple[int, str]:
            got = memo.get(part)
            if got is None:
                if len(memo) > 4000:
                    memo.clear()
                got = memo[part] = (len(encode([part])[0]), model.of(part) if model else "und")
            return got

        for batch in batches:
            n, lang = [], []
            for text in batch.column(batch.schema.get_field_index("__text")).to_pylist():
                if not text:
                    n.append(0)
                    lang.append("und")
                    continue
                at = text.rfind(split_at) if split_at else -1
                if at > 0 and not text[at - 1].isspace() and is_cuttable(tokenizer):
                    a, b = of(text[:at]), of(text[at:])
                    n.append(a[0] + b[0])
                    lang.append(a[1])
                else:
                    a = of(text)
                    n.append(a[0])
                    lang.append(a[1])
            columns = [batch.column(i) for i in range(len(keys))] + [pa.array(n, pa.int64()), pa.array(lang, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, keys + ["n_tokens", "guessed"])

    def cut(batches):
        for batch in batches:
            rows, pieces, salt = [], [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index("__text")).to_pylist()):
                for k, p in enumerate(parts(text)):
                    rows.append(i)
                    pieces.append(p)
                    salt.append(k)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(i) for i in range(len(keys))] + [pa.array(pieces, pa.string()), pa.array(salt, pa.int64())], keys + ["__text", "__salt"]
            )

    small = source.where(~large | F.col("__text").isNull()).mapInArrow(count, schema)
    if not is_cuttable(tokenizer):
        return small
    cuts = source.where(large).withColumn("__row", F.monotonically_increasing_id())
    ks, keys0 = keys + ["__row"], list(keys)
    keys = ks
    pieces = cuts.select(*ks, "__text").mapInArrow(cut, ", ".join(spark_types) + ", __row long, __text string, __salt long")
    spread = pieces.repartition(F.xxhash64("__row", "__salt")).select(*ks, "__text")
    counted = spread.mapInArrow(count, ", ".join(spark_types) + ", __row long, n_tokens long, guessed string")
    whole = counted.groupBy(*ks).agg(
        F.sum("n_tokens").alias("n_tokens"), F.max_by("guessed", "n_tokens").alias("guessed")
    ).select(*keys0, "n_tokens", "guessed")
    return small.unionByName(whole)


def language(stated, guessed):
    """The primary part of a stated language in lower case; where none is stated, the guess."""
    low = F.lower(F.trim(F.split(F.regexp_replace(stated, "_", "-"), "-")[0]))
    return F.when(low.isNull() | low.isin("", "und", "unknown"), guessed).otherwise(low)


def source_of(row_id):
    """The source of a row: its row_id without the number."""
    return F.regexp_replace(row_id, "-[0-9]+$", "")


def token_counts(passes: DataFrame, documents: DataFrame, tokenizer: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """One row per text: origin, row_id, kind, key, pos, doc_id, source, lang, domain, n_tokens."""
    model = fit_languages(documents)
    p = count_texts(passes.select("row_id", "kind", "key", "pos", "text"), ["row_id", "kind", "key", "pos"], "text", tokenizer, folder, "\n\n[", model)
    d = count_texts(
        documents.select("doc_id", "source", "lang", "domain", "text"), ["doc_id", "source", "lang", "domain"], "text", tokenizer, folder, None, model
    )
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    p = p.select(
        F.lit("passes").alias("origin"), "row_id", "kind", "key", "pos", none("long", "doc_id"),
        F.coalesce(source_of(F.col("row_id")), F.lit("unknown")).alias("source"), F.col("guessed").alias("lang"), F.lit("unknown").alias("domain"),
        "n_tokens"
    )
    d = d.select(
        F.lit("documents").alias("origin"), none("string", "row_id"), none("string", "kind"), none("string", "key"), none("int", "pos"), "doc_id",
        F.coalesce("source", F.lit("unknown")).alias("source"), language(F.col("lang"), F.col("guessed")).alias("lang"),
        F.coalesce("domain", F.lit("unknown")).alias("domain"), "n_tokens"
    )
    return p.unionByName(d)


def token_totals(counts: DataFrame) -> DataFrame:
    """Texts and tokens by source, by language, by domain, by all three, and over all; slice tells which."""
    t = counts.groupBy("origin", "source", "lang", "domain").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))
    one = lambda name, *by: t.groupBy(*by).agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).select(
        F.lit(name).alias("slice"), *[(F.col(c) if c in by else F.lit(None).cast("string")).alias(c) for c in ("source", "lang", "domain")], "texts", "tokens"
    )
    return one("source", "source").unionByName(one("lang", "lang")).unionByName(one("domain", "domain")).unionByName(
        one("source_lang_domain", "source", "lang", "domain")
    ).unionByName(one("all"))
