"""Lines of files: search, slices, renames, changed symbols, chunks and their hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workspace import committed


def lines(files: DataFrame) -> DataFrame:
    """(filePath, line, text), lines from 1; a last empty line is none."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n", "\n"), "\n$", "")
    return files.select("filePath", F.posexplode(F.split(body, "\n")).alias("at", "text")).select("filePath", (F.col("at") + 1).cast("long").alias("line"), "text")


def grep(files: DataFrame, pattern: str, limit: int = 50, width: int = 200) -> DataFrame:
    """The first lines, by path and number, that match a pattern in any case."""
    if not pattern or len(pattern) > 200:
        raise ValueError("a pattern has 1 to 200 characters")
    found = lines(files).filter(F.col("text").rlike(f"(?i){pattern}"))
    return found.select("filePath", "line", F.substring(F.trim("text"), 1, width).alias("text")).orderBy("filePath", "line").limit(min(max(limit, 1), 200))


def file_slice(files: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """(filePath, content, total) of lines start .. end, counted from 0, both within, the end held to the file."""
    parts = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\n$", ""), "\n")
    last = F.size(parts) - 1 if end is None else F.least(F.lit(end), F.size(parts) - 1)
    n = last - start + 1
    return files.select("filePath", F.when(n > 0, F.array_join(F.slice(parts, F.lit(start + 1), F.greatest(n, F.lit(0))), "\n")).otherwise("").alias("content"), F.size(parts).alias("total"))


def rename_preview(nodes: DataFrame, edges: DataFrame, files: DataFrame, target: str, old: str, new: str) -> DataFrame:
    """(filePath, line, old, new, source): the definition's line and the lines of files that refer to it, whole words
    replaced. A line that an edge names comes from the graph; in other files every line with the word is taken."""
    word = rf"\b{re.escape(old)}\b"
    own = nodes.filter(F.col("id") == target).select("filePath", F.col("startLine").alias("line"))
    refs = edges.filter(F.col("type").isin("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS") & (F.col("targetId") == target))
    at = F.try_element_at(F.split("id", ":"), F.lit(-2)).try_cast("long")
    using = refs.join(nodes.select(F.col("id").alias("sourceId"), "filePath"), "sourceId").select("filePath", at.alias("line"))
    wanted = own.union(using).distinct()
    body = lines(files).filter(F.col("text").rlike(word))
    exact = body.join(wanted.filter("line is not null"), ["filePath", "line"], "left_semi").withColumn("source", F.lit("graph"))
    searched = body.join(wanted.filter("line is null").select("filePath").distinct(), "filePath", "left_semi").withColumn("source", F.lit("text_search"))
    both = exact.union(searched.join(exact.select("filePath", "line"), ["filePath", "line"], "left_anti"))
    return both.select("filePath", "line", F.col("text").alias("old"), F.regexp_replace("text", word, new).alias("new"), "source")


def changed_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols whose lines overlap a hunk (filePath, startLine, endLine) of their file: equal paths, or one ending with
    the hunk's. Paths, each once, join on every suffix after a slash, so that each stays an equality; symbols
    then join on their path; hunks that touch are one."""
    parts = F.split(F.lower(F.translate("filePath", "\\", "/")), "/")
    symbols = nodes.filter("startLine > 0 and endLine > 0 and filePath is not null")
    h = _islands(hunks.select(F.lower(F.translate("filePath", "\\", "/")).alias("tail"), F.col("startLine").alias("h1"), F.col("endLine").alias("h2")))
    tails = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    meant = committed(symbols.select("filePath").distinct().select("filePath", tails.alias("tail")).join(h, "tail").select("filePath", "h1", "h2"), "changed-spans")
    return symbols.join(meant, (symbols["filePath"] == meant["filePath"]) & (F.col("startLine") <= F.col("h2")) & (F.col("endLine") >= F.col("h1")), "left_semi").distinct()


def _islands(hunks: DataFrame) -> DataFrame:
    """(tail, h1, h2) with overlapping and adjoining spans of a path joined into one."""
    order = Window.partitionBy("tail").orderBy("h1", "h2")
    before = F.max("h2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = hunks.distinct().withColumn("opens", (before.isNull() | (F.col("h1") > before + 1)).cast("int"))
    return opens.withColumn("island", F.sum("opens").over(order)).groupBy("tail", "island").agg(F.min("h1").alias("h1"), F.max("h2").alias("h2")).drop("island")


def changed_processes(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Flows with a changed step: how many, and the risk of all together."""
    hits = edges.filter("type = 'STEP_IN_PROCESS'").join(changed.select(F.col("id").alias("sourceId")).distinct(), "sourceId", "left_semi")
    return hits.groupBy(F.col("targetId").alias("process")).agg(F.count("*").alias("changed_steps"), F.min("step").alias("first_step"))


def change_risk(processes: Column) -> Column:
    return F.when(processes == 0, "low").when(processes <= 5, "medium").when(processes <= 15, "high").otherwise("critical")


def clean_content(text: Column) -> Column:
    """Unix line ends, lines without trailing blanks, at most one empty line in a row, trimmed."""
    x = F.regexp_replace(text, "\r\n", "\n")
    x = F.regexp_replace(x, "[ \t]+\n", "\n")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(x, "^[ \t\n]+", ""), "[ \t\n]+$", "")


def char_chunks(docs: DataFrame, size: int = 1200, overlap: int = 120, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, chunk, start, text, startLine, endLine): characters start .. start + size, each chunk `overlap` before the last one's end."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the size")
    step, n = size - overlap, F.length(text_col)
    count = F.greatest(F.ceil((n - overlap) / step), F.lit(1)).cast("int")
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # The text is cut into steps once; a chunk is a step and the beginning of what follows, and lines are counted on by steps.
    cut = docs.filter(n > 0).select(F.col(id_col).alias("id"), count.alias("c"), F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("steps"))
    cut = cut.withColumn("before", F.aggregate(F.transform("steps", newlines), F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))))
    after = lambda i: F.substring(F.array_join(F.slice("steps", i + 2, F.lit(-(-overlap // step))), ""), 1, overlap)
    made = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.struct(i.alias("chunk"), F.concat(F.element_at("steps", i + 1), after(i) if overlap else F.lit("")).alias("text"), (F.element_at("before", i + 1) + 1).alias("first")))
    spread = cut.select("id", F.explode(made).alias("m")).select("id", "m.*")
    return spread.select("id", "chunk", (F.col("chunk") * step).alias("start"), "text", F.col("first").cast("long").alias("startLine"), (F.col("first") + newlines(F.col("text"))).cast("long").alias("endLine"))


def embedding_status(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, status): fresh, changed, new, or gone, by content hash."""
    joined = now.select("id", F.col("hash").alias("h")).join(stored.select("id", F.col("hash").alias("s")), "id", "full")
    return joined.select("id", F.when(F.col("s").isNull(), "new").when(F.col("h").isNull(), "gone").when(F.col("h") == F.col("s"), "fresh").otherwise("changed").alias("status"))


_HEADER = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple[str, int, int, bool]]:
    """(path, first line, last line, deleted) of each hunk of a diff without context: new lines, or old ones of a deleted
    file. Hunks without lines are dropped."""
    out, old_path, path, deleted = [], "", "", False
    for line in text.splitlines():
        if line.startswith("--- "):
            old_path = line[4:].strip().removeprefix("a/")
        elif line.startswith("+++ "):
            name = line[4:].strip()
            deleted = name == "/dev/null"
            path = old_path if deleted else name.removeprefix("b/")
        elif (m := _HEADER.match(line)) and path:
            start, count = (m[1], m[2]) if deleted else (m[3], m[4])
            n = 1 if count is None else int(count)
            if n:
                out.append((path.lower(), int(start), int(start) + n - 1, deleted))
    return out
