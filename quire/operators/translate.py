"""Requests to a translator, its answers, and what a translation costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import collapse, extract_json_array, fields, is_blank, trim
from quire.operators.layout import PAGE
from quire.session import staged

#: Fixed values of the cost model: tokens per word, output per input, dollars per million tokens in and out.
TOKENS_PER_WORD, OUTPUT_SHARE, INPUT_PRICE, OUTPUT_PRICE = 1.33, 1.2, 0.15, 0.60


def stub(text: Column, target: str = "de") -> Column:
    """A translation that tests can foresee."""
    return F.concat(F.lit(f"[{target}] "), collapse(text))


def translated(blocks: DataFrame, provider: Callable[[Column], Column] = stub) -> DataFrame:
    """Adds `translated`; blank blocks pass through untouched and never reach the provider."""
    return blocks.withColumn("translated", F.when(is_blank(F.col("text")), F.col("text")).otherwise(provider(F.col("text"))))


def batch_prompts(blocks: DataFrame) -> DataFrame:
    """One JSON request per page over its non-blank blocks: id, text, and type unless empty. Tables keep their line breaks."""
    rows = blocks.filter(~is_blank(F.col("text")))
    text = F.when(F.col("block_type") == "table", F.col("text")).otherwise(collapse(F.col("text")))
    g = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("block_no", text.alias("text"), F.nullif("block_type", F.lit("")).alias("type")))).alias("b"))
    items = F.transform("b", lambda b, i: F.struct(i.alias("id"), b["text"].alias("text"), b["type"].alias("type")))
    body = F.to_json(items)
    for char in "<>&":
        body = F.replace(body, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return g.select(*PAGE, F.size("b").alias("n_blocks"), body.alias("items"))


#: What a model is told before a request; the last argument is the target language.
BATCH_PROMPT = """You translate the text blocks of a document page from {source} into {target}.
The request is a JSON array of blocks. Answer with nothing but a JSON array of strings: one translation for each block, as many as there are, in their order.
Each translation is one paragraph without line breaks, but the rows of a table block stay on lines of their own.
Keep numbers and marks of lists. Leave names, code, links and mail addresses as they are, and add no comments or markup."""
BLOCK_PROMPT = """You translate one text block of a document page from {source} into {target}.
Answer with nothing but the translation, as one paragraph without line breaks.
Keep numbers and marks of lists. Leave names, code, links and mail addresses as they are."""
UNKNOWN = "whatever language it is in"


def system_prompt(source: Column, target: Column, single: bool = False) -> Column:
    """The instructions for a batch of blocks or a single one; the source `auto` leaves the language to the model."""
    text = F.lit(BLOCK_PROMPT if single else BATCH_PROMPT)
    return F.replace(F.replace(text, F.lit("{source}"), F.when(source == "auto", UNKNOWN).otherwise(source)), F.lit("{target}"), target)


def parsed(responses: DataFrame) -> DataFrame:
    """Adds translations, or an error where the answer isn't an array of strings or of objects with a text, or has another length."""
    body = F.try_parse_json(extract_json_array(F.col("content")))
    kind = F.schema_of_variant(body)
    rows = responses.withColumns({"_v": body, "_k": kind})
    texts = F.from_json(extract_json_array(F.col("content")), "array<string>")
    objects = F.from_json(extract_json_array(F.col("content")), "array<struct<text:string>>")
    found = F.when(F.col("_k").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.transform(texts, lambda t: F.coalesce(t, F.lit("")))).when(F.col("_k").startswith("ARRAY<OBJECT"), F.transform(objects, lambda o: F.coalesce(o["text"], F.lit(""))))
    rows = rows.withColumn("_t", found)
    error = F.when(F.col("_t").isNull(), "invalid JSON").when(F.size("_t") != F.col("expected"), F.format_string("expected %d translations, got %d", F.col("expected").cast("int"), F.size("_t")))
    return rows.withColumns({"error": error, "translations": F.when(error.isNull(), F.col("_t"))}).drop("_v", "_k", "_t")


TABLE_HINT = "This is a cell of a table: keep its rows on lines of their own.\n\n"


def single_requests(items: DataFrame) -> DataFrame:
    """Adds `request`: what a model is asked for one block. Cells of tables come with a hint."""
    return items.withColumn("request", F.when(F.col("block_type") == "table", F.concat(F.lit(TABLE_HINT), F.col("text"))).otherwise(F.col("text")))


def with_fallback(batches: DataFrame, items: DataFrame, ask: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Each item (key, n from 0, text, block_type) with translated, via (`batch` or `single`) and error.

    `batches` holds a batch's answer (key, content, expected). An answer that doesn't validate, or
    is missing, sends its items out one by one: `ask` turns single requests into (key, n, content,
    error). An item fails by itself, with its own error, and others of its batch stand.

    Valid answers are exploded and joined by place, failed ones decide by their key which items
    are asked, so the second level costs in proportion to the failures. Both joins are on the
    key, and answers of hot keys may be split by adaptive execution.
    """
    judged = staged(parsed(batches).select(key, "error", "translations"), "judged-batches")
    fine = judged.filter("error is null").select(key, F.posexplode("translations").alias("n", "translated"))
    whole = items.join(fine, [key, "n"]).select(*items.columns, "translated", F.lit("batch").alias("via"), F.lit(None).cast("string").alias("error"))
    open_ = items.join(judged.filter("error is null").select(key), key, "left_anti")
    said = ask(single_requests(open_)).select(key, "n", F.col("content").alias("_c"), F.col("error").alias("_e"))
    text = F.when(F.col("_e").isNull(), trim(F.col("_c")))
    alone = open_.join(said, [key, "n"], "left").withColumn("error", F.coalesce("_e", F.when(F.col("_c").isNull(), "no answer")))
    alone = alone.select(*items.columns, text.alias("translated"), F.lit("single").alias("via"), "error")
    return whole.unionByName(alone)


def cost(blocks: DataFrame, *keys: str) -> DataFrame:
    """Estimated tokens and dollars over blocks."""
    g = blocks.groupBy(*keys).agg(F.coalesce(F.sum(F.size(fields(F.col("text")))), F.lit(0)).alias("_w"))
    g = g.withColumn("input_tokens", (F.col("_w") * TOKENS_PER_WORD).cast("long"))
    g = g.withColumn("output_tokens", (F.col("input_tokens") * OUTPUT_SHARE).cast("long"))
    usd = F.col("input_tokens") / 1e6 * INPUT_PRICE + F.col("output_tokens") / 1e6 * OUTPUT_PRICE
    return g.withColumn("cost_usd", usd).drop("_w")
