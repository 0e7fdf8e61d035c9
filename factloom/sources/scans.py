"""Scans of the file formats that the engine reads. All lazy but `gtest_xml`; bad lines are told apart, never silently typed."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.paths import matches_any
from factloom.operators.logs import in_window, parse_lines
from factloom.scratch import stage


class CorruptSnapshot(ValueError):
    """Stored lines that don't fit their digests or can't be read."""


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file) of text files, gzip included; blank lines stay."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, pos): lines with an ordinal that grows within each file; files are read whole to keep the order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"), F.col("_metadata.file_name").alias("file"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("t", r"\r?\n\z", ""), r"\r?\n")).alias("pos", "value")).select("value", "file", (F.col("pos") + 1).alias("pos"))


def stored_lines(spark: SparkSession, path: str, key: str = "object_id") -> DataFrame:
    """Envelopes (schema_version, key, kind, payload, payload_sha256) of stored JSON lines; `sound` tells whether the digest fits."""
    schema = f"schema_version int, {key} string, fact_kind string, relation_kind string, payload string, payload_sha256 string"
    rows = text_lines(spark, path).where("value <> ''").select("file", F.from_json("value", schema).alias("x")).select("file", "x.*")
    return rows.withColumn("sound", F.coalesce(F.sha2("payload", 256) == F.col("payload_sha256"), F.lit(False)))


def require_sound(lines: DataFrame) -> DataFrame:
    """Raises if any line's digest does not fit."""
    if lines.where("not sound").limit(1).count():
        raise CorruptSnapshot("a stored line does not fit its digest")
    return lines


def event_log(spark: SparkSession, folder: str, channel: str | None = None, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events (file, pos and the event's fields) and problems (file, pos, issue) of a folder of channel logs."""
    lines = parse_lines(numbered_lines(spark, f"{folder}/{channel or '*'}.jsonl"))
    events = lines.where("issue is null").select("file", "pos", "event.*").where(in_window(F.col("timestamp"), since, until))
    return events, lines.where("issue is not null").select("file", "pos", "issue")


def compile_journal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Journal rows (argv, cwd, src, out, miss, reason, ts, pos); lines that are no object are skipped."""
    schema = "argv array<string>, cwd string, src string, out string, miss boolean, reason string, ts string"
    rows = numbered_lines(spark, path).select("file", "pos", F.from_json("value", schema).alias("x"), F.try_parse_json("value").alias("v"))
    return rows.where(F.schema_of_variant("v").startswith("OBJECT")).select("file", "pos", "x.*")


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("arguments array<string>, command string, directory string, file string, output string").option("multiLine", True).json(path)


def match_journal(spark: SparkSession, path: str, match_id: str | None = None) -> DataFrame:
    """Events (event_pos, event, match_id, run_id, task, task_id, round, seat, ts); malformed lines are skipped."""
    fields = "event string, match_id string, run_id string, task string, task_id string, round int, seat string, ts string"
    rows = numbered_lines(spark, path).where(F.try_parse_json("value").isNotNull()).select(F.col("pos").alias("event_pos"), F.from_json("value", fields).alias("x")).select("event_pos", "x.*")
    return rows if match_id is None else rows.where(F.col("match_id") == match_id)


def json_object(spark: SparkSession, path: str) -> dict | None:
    """One JSON document, or None if there is none."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
    except Exception:  # noqa: BLE001  a missing file is no document
        return None
    import json

    try:
        value = json.loads(rows[0][0]) if rows else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def file_tree(spark: SparkSession, root: str, globs: list[str], pruned: tuple[str, ...] = (".git",)) -> DataFrame:
    """(path, size, mtime, content): files under root whose relative path matches a glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    start = F.lit(len(root.rstrip("/")) + 2)
    local = F.regexp_replace("path", "^file:/*", "/")
    rel = F.substring(local, start, F.length(local))
    out = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    hidden = F.col("path").rlike("(^|/)(" + "|".join(p.replace(".", r"\.") for p in pruned) + ")(/|$)")
    return out.where(matches_any(F.col("path"), globs) & ~hidden)


def census(files: DataFrame) -> DataFrame:
    """(path, size, mtime_ns, sha256) of a `file_tree`."""
    return files.select("path", "size", (F.unix_micros("mtime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("sha256"))


def source_texts(files: DataFrame) -> DataFrame:
    """(path, text) of a `file_tree`; bytes that are no UTF-8 are replaced."""
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


#: What every test case begins with, and what follows it in a case that is whole before the next one begins.
_CASE = "<testcase"
_WHOLE = r"(?s)^(?=[\s/>])(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+(?:/>|>.*?</testcase>)"


def _case_end(text: str, quote: str, body: bool) -> tuple[int | None, str, bool]:
    """Where a case ends that begins or goes on in `text`, or None; the quote that is open in its tag then, and whether the tag is over."""
    at = 0
    while not body:
        found = re.compile(quote or "[>\"']").search(text, at)
        if not found:
            return None, quote, False
        at = found.end()
        if found[0] != ">":
            quote = "" if quote else found[0]
        elif text[at - 2] == "/":
            return at, "", True
        else:
            body = True
    end = text.find("</testcase>", at)
    return (None if end < 0 else end + len("</testcase>")), "", True


def _cut_cases(pieces: Iterator[str]) -> Iterator[str]:
    """The cases of one file, from its text before the first case and after each start of one; a case may go on over several pieces."""
    next(pieces, None)
    back, ends = deque(), True
    while (piece := back.popleft() if back else next(pieces, None)) is not None:
        if re.match(r"[\w.:-]", piece):  # a longer name
            continue
        read = [_CASE + piece]
        end, quote, body = _case_end(read[0], "", False)
        plain = body
        while end is None and (ends or not plain):
            if (more := back.popleft() if back else next(pieces, None)) is None:
                # it never ends, so what follows it is looked at again; if its own piece has the whole tag, no end tag follows at all
                ends = ends and not plain
                back.extend(r.removeprefix(_CASE) for r in read[1:])
                break
            read.append(_CASE + more)
            end, quote, body = _case_end(read[-1], quote, body)
        if end is not None:
            yield "".join(read[:-1]) + read[-1][:end]


def _cut_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, run_id, pos, text): the cases of files whose pieces come in order."""
    pieces = (r for b in batches for r in b[["file", "run_id", "value"]].itertuples(index=False, name=None))
    for (file, run), own in groupby(pieces, key=lambda r: r[:2]):
        numbered = enumerate(_cut_cases(r[2] for r in own))
        while some := list(islice(numbered, 1000)):
            yield pd.DataFrame({"file": file, "run_id": run, "pos": [n for n, _ in some], "text": [t for _, t in some]})


def _parsed_cases(cases: DataFrame) -> DataFrame:
    """The columns of a test from `text`, null or empty where it is no XML; `sound` tells whether it is."""
    from factloom.operators.runs import elapsed_ms

    schema = (
        "_classname string,_class string,_name string,_time string,_status string,failure array<struct<_message:string,_VALUE:string>>,"
        "error array<struct<_message:string,_VALUE:string>>,skipped array<struct<_message:string,_VALUE:string>>,_corrupt_record string"
    )
    kept = [c for c in cases.columns if c != "text"]
    rows = cases.select(*kept, F.explode(F.array(F.from_xml("text", schema))).alias("c"))  # parsed once, whatever is taken of it
    failed, skipped = F.coalesce("c.failure", "c.error"), F.col("c.skipped")
    text = lambda a: F.coalesce(F.nullif(F.try_element_at(a, F.lit(1))["_message"], F.lit("")), F.try_element_at(a, F.lit(1))["_VALUE"], F.lit(""))
    status = F.when(failed.isNotNull(), "failed").when(skipped.isNotNull() | F.coalesce(F.col("c._status") == "notrun", F.lit(False)), "skipped").otherwise("passed")
    return rows.select(
        *kept, F.col("c._corrupt_record").isNull().alias("sound"), F.coalesce(F.nullif("c._classname", F.lit("")), F.nullif("c._class", F.lit("")), F.lit("")).alias("suite"), F.coalesce("c._name", F.lit("")).alias("name"), status.alias("status"),
        elapsed_ms(F.coalesce("c._time", F.lit("0"))).alias("elapsed_ms"), F.when(failed.isNotNull(), text(failed)).when(skipped.isNotNull(), text(skipped)).otherwise("").alias("message"),
    )


def gtest_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(run_id, pos, suite, name, status, elapsed_ms, message) of gtest XML files; the run id is the file's name.

    Only the cases count, wherever they stand. Files are read in splits, cut
    before each case, so that no task holds more than a case at a time; the
    tests are staged, and their places follow from the numbers of cases in the
    splits before. A file with a case that goes on beyond the start of another
    one, or never ends, is cut in order by one task, which holds that case (if
    it never ends, the rest of the file). A file with a case that is no XML
    gives no rows: a report that can't be read tells no results.
    """
    run = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.xml)?$", 1)
    # the low 33 bits of this built-in are the row's place in its partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    pieces = spark.read.text(path, lineSep=_CASE).select(F.col("_metadata.file_path").alias("file"), run.alias("run_id"), F.col("_metadata.file_block_start").alias("block"), place.alias("i"), "value")
    texts = pieces.select("file", "run_id", "block", "i", F.regexp_extract("value", _WHOLE, 0).alias("text")).withColumn("whole", F.col("text") != "").withColumn("text", F.concat(F.lit(_CASE), "text"))
    tests = stage(_parsed_cases(texts), "gtest")

    # The first piece of a file is what stands before its first case; it counts for nothing.
    top = F.when(F.col("block") == 0, 1).otherwise(0)
    odd, bad = ~F.col("whole"), F.col("whole") & ~F.col("sound")
    counted = tests.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"), F.count_if(bad).alias("bad"), F.min(F.struct("i", odd.cast("int").alias("odd"), bad.cast("int").alias("bad"))).alias("head"))
    own = counted.select("file", "block", (F.col("n") - top).alias("n"), (F.col("odd") - top * F.col("head.odd")).alias("odd"), (F.col("bad") - top * F.col("head.bad")).alias("bad"), (F.col("head.i") + top).alias("start"))
    of_file = Window.partitionBy("file")  # a row per split
    before = F.coalesce(F.sum("n").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = stage(own.select("file", "block", (before - F.col("start")).alias("shift"), "start", F.sum("odd").over(of_file).alias("odd"), F.sum("bad").over(of_file).alias("bad")), "gtest-splits")
    fields = ["suite", "name", "status", "elapsed_ms", "message"]
    plain = F.broadcast(splits.where("odd = 0 and bad = 0").select("file", "block", "start", "shift"))  # a row per split
    out = tests.join(plain, ["file", "block"]).where("i >= start").select("run_id", (F.col("i") + F.col("shift")).cast("int").alias("pos"), *fields)
    torn = splits.where("odd > 0").select("file").distinct()
    if torn.isEmpty():
        return out
    ordered = pieces.join(torn, "file", "left_semi").repartition("file").sortWithinPartitions("file", "block", "i").select("file", "run_id", "value")
    rest = stage(_parsed_cases(ordered.mapInPandas(_cut_files, "file string, run_id string, pos int, text string")), "gtest-torn")
    return out.unionByName(rest.join(rest.where("not sound").select("file").distinct(), "file", "left_anti").select("run_id", "pos", *fields))


def listed_tests(lines: DataFrame, line: str = "value") -> DataFrame:
    """Number of cases in a test listing: its indented lines."""
    return lines.agg(F.count_if(F.col(line).rlike(r"^\s+\S")).alias("n_listed"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(type, content) of transcript lines."""
    schema = "type string, message struct<content: array<struct<type: string, name: string>>>"
    return text_lines(spark, path).select(F.from_json("value", schema).alias("x")).select("x.type", F.col("x.message.content").alias("content"))


def catalog(books: DataFrame) -> DataFrame:
    """(name, file, conflict): named documents (name, file), and whether a name is used more than once."""
    n = books.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    return books.join(n, "name").select("name", "file", (F.col("_n") > 1).alias("conflict"))
