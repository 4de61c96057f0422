"""COBOL and JCL facts: programs, sections, paragraphs, performs, calls, copies; jobs, steps, data sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

FACTS = "filePath string, fact string, name string, parent string, program string, target string, line int"
_PROGRAM = re.compile(r"^\s*PROGRAM-ID\.\s*([A-Z0-9][\w-]*)", re.I)
_END = re.compile(r"^\s*END\s+PROGRAM\s+([\w-]+)", re.I)
_SECTION = re.compile(r"^\s{0,3}([A-Z0-9][\w-]*)\s+SECTION\s*\.", re.I)
_PARAGRAPH = re.compile(r"^\s{0,3}([A-Z0-9][\w-]*)\s*\.\s*$", re.I)
_PERFORM = re.compile(r"\bPERFORM\s+(?!UNTIL\b|VARYING\b|TIMES\b|WITH\b|\d+\s+TIMES\b)([A-Z0-9][\w-]*)(?:\s+(?:THRU|THROUGH)\s+([A-Z0-9][\w-]*))?", re.I)
_CALL = re.compile(r"""\bCALL\s+["']([^"']+)["']""", re.I)
_COPY = re.compile(r"""\bCOPY\s+["']?([A-Z0-9][\w-]*)["']?([^.]*)\.""", re.I)
_REPLACING = re.compile(r"(?:==(.*?)==|([\w-]+|'[^']*'|\"[^\"]*\"))\s+BY\s+(?:==(.*?)==|([\w-]+|'[^']*'|\"[^\"]*\"))", re.I | re.S)
_DIVISIONS = {"IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE", "EXIT", "GOBACK", "STOP", "CONTINUE"}
_JOB, _EXEC, _DD = re.compile(r"^//(\w+)\s+JOB\b", re.I), re.compile(r"^//(\w*)\s+EXEC\s+(?:PGM=|PROC=)?([\w$#@]+)", re.I), re.compile(r"^//(\w+)\s+DD\b.*?\bDSN(?:AME)?=([\w.$#@&()+-]+)", re.I)


def replacements(clause: str) -> list[tuple[str, str]]:
    """Pairs of a COPY ... REPLACING clause: pseudo-text or words."""
    _, _, rest = re.sub(r"\s+", " ", clause).partition("REPLACING ")
    return [((m[1] if m[1] is not None else m[2]).strip(), (m[3] if m[3] is not None else m[4]).strip()) for m in _REPLACING.finditer(rest)]


def expand(text: str, pairs: list[tuple[str, str]]) -> str:
    """A copybook's text with whole words, or pseudo-text, replaced."""
    for old, new in pairs:
        text = re.sub(rf"(?<![\w-]){re.escape(old)}(?![\w-])", lambda _, n=new: n, text, flags=re.I)
    return text


def _cobol(path: str, text: str) -> Iterator[dict]:
    stack: list[str] = []
    section = paragraph = None
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw[7:72] if re.match(r"^[\d ]{6}[ *\-/dD]", raw) else raw
        if raw[6:7] in ("*", "/") or line.lstrip().startswith("*"):
            continue
        at = lambda fact, name, target=None: {"filePath": path, "fact": fact, "name": name, "parent": paragraph or section, "program": stack[-1] if stack else None, "target": target, "line": n}  # noqa: B023, E731
        if m := _PROGRAM.match(line):
            stack.append(m[1].upper())
            section = paragraph = None
            yield at("program", m[1].upper())
        elif m := _END.match(line):
            if m[1].upper() in stack:
                del stack[stack.index(m[1].upper()) :]
            section = paragraph = None
        elif (m := _SECTION.match(line)) and stack:
            section, paragraph = m[1].upper(), None
            yield at("section", section) | {"parent": None}
        elif (m := _PARAGRAPH.match(line)) and stack and m[1].upper() not in _DIVISIONS and not m[1].isdigit():
            paragraph = m[1].upper()
            yield at("paragraph", paragraph) | {"parent": section}
        else:
            for m in _PERFORM.finditer(line):
                yield at("perform", m[1].upper(), m[2].upper() if m[2] else None)
            for m in _CALL.finditer(line):
                yield at("call", m[1].upper())
        for m in _COPY.finditer(line):
            yield at("copy", m[1].upper(), ";".join(f"{a}={b}" for a, b in replacements(m[2])) or None)


def _jcl(path: str, text: str) -> Iterator[dict]:
    job = step = None
    for n, line in enumerate(text.splitlines(), 1):
        at = lambda fact, name, target=None: {"filePath": path, "fact": fact, "name": name, "parent": step, "program": job, "target": target, "line": n}  # noqa: B023, E731
        if m := _JOB.match(line):
            job, step = m[1].upper(), None
            yield at("job", job)
        elif m := _EXEC.match(line):
            step = m[1].upper() or f"STEP{n}"
            yield at("step", step, m[2].upper()) | {"parent": None}
        elif m := _DD.match(line):
            yield at("dataset", m[2].upper(), m[1].upper())


def facts(files: DataFrame) -> DataFrame:
    """Facts of the COBOL and JCL files among files (filePath, content)."""

    def run(batches):
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                jcl = f.filePath.lower().endswith((".jcl", ".job", ".proc"))
                rows += (_jcl if jcl else _cobol)(f.filePath, f.content or "")
            out = pd.DataFrame(rows, columns=[x.strip().split(" ")[0] for x in FACTS.split(",")])
            out["line"] = out["line"].astype("int32")
            yield out

    return files.filter(F.lower("filePath").rlike(r"\.(cbl|cob|cpy|cobol|copybook|jcl|job|proc)$")).select("filePath", "content").mapInPandas(run, FACTS)


def edges(found: DataFrame) -> DataFrame:
    """(sourceId, targetId, type, reason): contains, performs within a program, calls of programs, copies, and steps' programs and data sets."""
    key = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *parts)
    program = lambda c: key("Module", F.col(c))
    owner = F.coalesce(key("Function", F.col("program"), F.col("parent")), program("program"))
    pick = lambda df, a, b, kind, reason: df.select(a.alias("sourceId"), b.alias("targetId"), F.lit(kind).alias("type"), F.lit(reason).alias("reason"))
    parts = found.filter("fact in ('section', 'paragraph')").select("program", "name").distinct()
    performed = found.filter("fact = 'perform'").join(parts.withColumnRenamed("name", "n").withColumnRenamed("program", "p"), F.expr("name = n and program = p"))
    through = found.filter("fact = 'perform' and target is not null").join(parts.withColumnRenamed("name", "n").withColumnRenamed("program", "p"), F.expr("target = n and program = p"))
    programs = found.filter("fact = 'program'").select(F.col("name").alias("p")).distinct()
    called = found.filter("fact = 'call'").join(programs, F.col("name") == F.col("p"))
    stepped = found.filter("fact = 'step'").join(programs, F.col("target") == F.col("p"))
    inside = found.filter("fact in ('section', 'paragraph')")
    owner = F.when(F.col("parent").isNull(), program("program")).otherwise(key("Function", F.col("program"), F.col("parent")))
    out = [
        pick(found.filter("fact in ('program', 'job')"), key("File", F.col("filePath")), program("name"), "CONTAINS", "cobol"),
        pick(inside, owner, key("Function", F.col("program"), F.col("name")), "CONTAINS", "cobol"),
        pick(performed, owner, key("Function", F.col("program"), F.col("name")), "CALLS", "cobol-perform"),
        pick(through, owner, key("Function", F.col("program"), F.col("target")), "CALLS", "cobol-perform-thru"),
        pick(called, owner, program("name"), "CALLS", "cobol-call"),
        pick(found.filter("fact = 'copy'"), key("File", F.col("filePath")), key("Module", F.col("name")), "IMPORTS", "cobol-copy"),
        pick(found.filter("fact = 'step'"), program("program"), key("CodeElement", F.col("program"), F.col("name")), "CONTAINS", "jcl-step"),
        pick(stepped, key("CodeElement", F.col("program"), F.col("name")), program("target"), "CALLS", "jcl-program"),
        pick(found.filter("fact = 'dataset' and parent is not null"), key("CodeElement", F.col("program"), F.col("parent")), key("CodeElement", F.col("name")), "CALLS", "jcl-dataset"),
    ]
    all_ = out[0]
    for e in out[1:]:
        all_ = all_.union(e)
    return all_.distinct()
