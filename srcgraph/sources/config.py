"""Configuration files as a table (projectRoot, key, value, sourceFile, profile, priority), and the expansion of ${key:default}."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where configuration lies below a project, and what it is called.
FOLDERS = ("src/main/resources", "config", "src/main/resources/config")
NAME = r"(?:application|bootstrap)\.(?:yml|yaml|properties)|application-.*"
PROFILE = r"application-([^.]+)\.(?:yml|yaml|properties)"
PASSES = 5
HOLDER = re.compile(r"\$\{([^{}:]+)(?::([^{}]*))?\}")
SCHEMA = "projectRoot string, key string, value string, sourceFile string, profile string, priority int"


def as_text(leaf) -> str:
    if leaf is None:
        return "null"
    if isinstance(leaf, bool):
        return "true" if leaf else "false"
    return str(leaf)


def flatten(value, prefix: str = "") -> list[tuple[str, str]]:
    """Objects by dots, arrays by [i], leaves as text."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flatten(v, f"{prefix}.{as_text(k)}" if prefix else as_text(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flatten(v, f"{prefix}[{i}]")]
    return [(prefix, as_text(value))] if prefix else []


def read_yaml(text: str) -> list[tuple[str, str]]:
    import yaml

    class Loader(yaml.SafeLoader):
        """Only true and false are booleans: on, off, yes and no are texts."""

        yaml_implicit_resolvers = {c: [(t, r) for t, r in known if t != "tag:yaml.org,2002:bool"] for c, known in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return [x for part in yaml.load_all(text, Loader) if part is not None for x in flatten(part)]


def read_properties(text: str) -> list[tuple[str, str]]:
    """Lines of key=value, key:value or key value; # and ! are comments; a last backslash joins the next line."""
    lines = re.sub(r"\\\r?\n[ \t]*", "", text).splitlines()
    out = []
    for line in lines:
        line = line.strip()
        if line and line[0] not in "#!":
            m = re.match(r"((?:\\.|[^=:\s\\])*)\s*[=:]?\s*(.*)$", line)
            out.append((re.sub(r"\\(.)", r"\1", m[1]), re.sub(r"\\(.)", r"\1", m[2])))
    return out


def entries(files: DataFrame) -> DataFrame:
    """files: (path, content). One row an entry of each configuration file; a file that cannot be read gives none."""
    where = "|".join(re.escape(f) for f in sorted(FOLDERS, key=len, reverse=True))
    parts = rf"^(.*?)/?(?:{where})/([^/]+)$"
    found = files.select(F.regexp_extract("path", parts, 1).alias("projectRoot"), F.regexp_extract("path", parts, 2).alias("name"), F.col("path").alias("sourceFile"), F.col("content").cast("string"))
    found = found.where(F.col("name").rlike(f"^(?:{NAME})$"))
    profile = F.regexp_extract("name", f"^{PROFILE}$", 1)
    found = found.select("projectRoot", "sourceFile", "content", F.when(profile != "", profile).otherwise("default").alias("profile"), F.when(profile != "", 10).otherwise(1).alias("priority"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    pairs = read_properties(r.content) if r.sourceFile.endswith(".properties") else read_yaml(r.content)
                except Exception:
                    continue
                rows += [(r.projectRoot, k, v, r.sourceFile, r.profile, r.priority) for k, v in pairs]
            yield pd.DataFrame(rows, columns=["projectRoot", "key", "value", "sourceFile", "profile", "priority"])

    return found.mapInPandas(run, SCHEMA)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Configuration entries of all projects below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yml,yaml,properties}").load(root)
    return entries(files.select("path", F.col("content").cast("string")))


def dictionary(config: DataFrame) -> DataFrame:
    """(projectRoot, config): key -> its distinct values, by priority and then by text. A project's keys are one row."""
    best = config.groupBy("projectRoot", "key", "value").agg(F.max("priority").alias("priority"))
    values = best.groupBy("projectRoot", "key").agg(F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("p"), "value"))).alias("v"))
    values = values.select("projectRoot", "key", F.col("v.value").alias("v"))
    return values.groupBy("projectRoot").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("config"))


def sizes(config: DataFrame) -> DataFrame:
    return config.groupBy("projectRoot").agg(F.countDistinct("key").alias("keys"))


def expand(text: str, config: dict[str, list[str]]) -> list[str]:
    """All values of a text with ${key:default}, the first one a pass, PASSES passes; an unknown key without a default stays."""
    values = [text]
    for _ in range(PASSES):
        out = []
        for v in values:
            m = HOLDER.search(v)
            known = config.get(m[1].strip()) if m else None
            if m and known is None:
                known = [m[2]] if m[2] is not None else None
            out += [v] if known is None else [v[: m.start()] + k + v[m.end() :] for k in known]
        out = list(dict.fromkeys(out))
        if out == values:
            break
        values = out
    return values
