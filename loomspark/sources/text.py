"""Retrieval and question data in text files, and results as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import STOPS, chat_format, default_system, templated, trimmed
from loomspark.operators import batching


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a line that isn't JSON ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def string_field(column: str) -> Column:
    """Missing is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines {_id, title, text} to (doc_id, text), title and text joined and trimmed."""
    rows = json_lines(spark, path, "_id string, title string, text string")
    return rows.select(string_field("_id").alias("doc_id"), trimmed(F.concat(string_field("title"), F.lit(" "), string_field("text"))).alias("text"))


def _place() -> Column:
    """The place of a line by name of its file: ranges of files may be read in any order, so where a range starts, and then the place in it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines {_id, text} to (qid, text); of equal ids the last line holds, of the last file by name."""
    rows = json_lines(spark, path, "_id string, text string").select(string_field("_id").alias("qid"), string_field("text").alias("text"), _place().alias("at"))
    return rows.groupBy("qid").agg(F.max_by("text", "at").alias("text"))


def parsed_qrels(lines: DataFrame) -> DataFrame:
    """`lines` (file, at, value) to (qid, doc_id, rel): lines of three tab-separated fields, without the first line of each file; a rel that isn't a
    number from 0 up is 0; of equal pairs the last line holds, of the last file by name."""
    first = lines.groupBy("file").agg(F.min("at").alias("head"))  # a row a file
    rows = lines.join(F.broadcast(first), "file").where("at > head").select(F.struct("file", "at").alias("at"), F.split("value", "\t").alias("f")).where("size(f) = 3")
    rel = F.greatest(F.coalesce(F.get("f", 2).try_cast("int"), F.lit(0)), F.lit(0))
    return rows.groupBy(F.get("f", 0).alias("qid"), F.get("f", 1).alias("doc_id")).agg(F.max_by(rel, "at").alias("rel"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    # ranges of a file may be read in any order: where a range starts, and then the place in it
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    return parsed_qrels(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value"))


def question_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines {question, context, answers} to contexts (context_id, context), numbered in the order they first come, files by name, and
    questions (at, question, context_id, answers)."""
    rows = json_lines(spark, path, "question string, context string, answers array<string>").withColumn("at", _place())
    firsts = rows.groupBy("context").agg(F.min("at").alias("at"))
    contexts = batching.numbered(firsts, "context_id", "at").select("context_id", "context")
    return contexts, rows.join(contexts, "context").select("at", "question", "context_id", "answers")


def prompts(spark: SparkSession, path: str, template: str | None = None) -> DataFrame:
    """One prompt a line that isn't blank; with a chat template, the trimmed line as its user turn."""
    lines = spark.read.text(path).where(trimmed(F.col("value")) != "")
    if template is None:
        return lines.select(F.col("value").alias("prompt"))
    said = F.array(F.struct(F.lit("user").alias("role"), trimmed(F.col("value")).alias("text")))
    return lines.select(templated(said, F.lit(template)).alias("prompt"))


def tokenizer_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders below `path` that hold a tokenizer.json to (folder, format, default_system, vocabulary, stop_ids): the chat format of the template in
    tokenizer_config.json (plain without one), distinct ids, and the ids of the tokens that end an answer, added tokens before those of the vocabulary."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)

    def files(name: str, schema: str) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
        return read.select(folder.alias("folder"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("folder", "x.*")

    heads = files("tokenizer.json", "added_tokens array<struct<id int, content string>>, model struct<vocab map<string, int>>")
    chats = files("tokenizer_config.json", "chat_template string")
    rows = heads.join(chats, "folder", "left").withColumn("template", F.coalesce("chat_template", F.lit("")))
    added = F.coalesce("added_tokens", F.array().cast("array<struct<id int, content string>>"))
    number = lambda t: F.coalesce(F.get(F.filter(added, lambda a: a["content"] == t), 0)["id"], F.try_element_at("model.vocab", t))
    stops = F.create_map(*[x for k, v in STOPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    ids = F.array_compact(F.transform(F.element_at(stops, chat_format(F.col("template"))), number))
    size = F.size(F.array_distinct(F.concat(F.map_values("model.vocab"), F.transform(added, lambda a: a["id"]))))
    return rows.select("folder", chat_format(F.col("template")).alias("format"), default_system(F.col("template")).alias("default_system"), size.alias("vocabulary"), ids.alias("stop_ids"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
