"""Who owns a changed file: rule files, patterns, last match, identities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import owner_type

MAX_SOURCE_BYTES = 3 << 20

def parse_rule(line: str) -> tuple[str, list[str]] | None:
    """Pattern and owner tokens of a line; None for blanks, comments and lines that end in an escape."""
    line = line.rstrip("\r").lstrip(" \t")
    if not line or line.startswith(("#", "\\#")):
        return None
    m = re.match(r"((?:\\.|[^\\\s])+)(?=\s|$)", line)
    if not m:
        return None
    tokens = []
    for token in line[m.end() :].split():
        if token.startswith("#"):
            break
        tokens.append(token)
    return m[1], tokens


def pattern_regex(pattern: str) -> str | None:
    """A regular expression for a pattern; None for what isn't supported: negation, character ranges, nothing at all."""
    if pattern.startswith("!") or re.search(r"(?<!\\)(?:\\\\)*[\[\]]", pattern):
        return None
    body = pattern.removeprefix("/")
    folder = body.endswith("/")
    body = body[:-1] if folder else body
    if not body or re.search(r"(?<!\\)(?:\\\\)*\\$", body):
        return None
    out = "^" if pattern.startswith("/") or "/" in body else "(?:^|.*/)"
    pieces = re.findall(r"\\.|\*+/?|[^\\*]", body, re.S)
    for i, piece in enumerate(pieces):
        at_start = i == 0 or pieces[i - 1].endswith("/")
        if piece.startswith("\\"):
            out += re.escape(piece[1])
        elif piece[0] == "*":
            if piece == "**/" and at_start:
                out += "(?:[^/]+/)*"
            elif piece == "**" and at_start and i == len(pieces) - 1:
                out += ".*"
            else:
                out += "[^/]*" + ("/" if piece.endswith("/") else "")
        else:
            out += "[^/]" if piece == "?" else re.escape(piece)
    last = body.rsplit("/", 1)[-1]
    if folder or not re.search(r"[*?]", re.sub(r"\\.", "", last)):
        out += "(?:/.*)?"
    return out + "$"


def parse_codeowners(sources: DataFrame) -> DataFrame:
    """(source_id, content) to (source_id, line, pattern, regex, tokens); rules that can't be compiled are skipped."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, content in zip(batch["source_id"], batch["content"], strict=True):
                for number, line in enumerate((content or "").replace("\r\n", "\n").split("\n"), 1):
                    if (rule := parse_rule(line)) and (regex := pattern_regex(rule[0])):
                        rows.append((source, number, rule[0], regex, rule[1]))
            yield pd.DataFrame(rows, columns=["source_id", "line", "pattern", "regex", "tokens"])

    return sources.select("source_id", "content").mapInPandas(parse, "source_id string, line int, pattern string, regex string, tokens array<string>")


def resolve_owners(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (source_id, path) with the last rule that matches; a rule without owners clears them. One row per file and token, or one without."""
    path = F.regexp_replace("path", "^/", "")
    met = files.join(rules, "source_id").where(F.regexp_like(path, F.col("regex")))
    keys = files.columns
    last = met.groupBy(*keys).agg(F.max_by(F.struct("line", "pattern", "tokens"), "line").alias("m"))
    out = files.distinct().join(last, keys, "left").select(*keys, "m.line", "m.pattern", F.explode_outer(F.array_distinct("m.tokens")).alias("owner_token"))
    return out.withColumn("owner_type", F.when(F.col("owner_token").isNotNull(), owner_type(F.col("owner_token"))))


def known_identities(*facts: DataFrame) -> DataFrame:
    """Of all (identity_type, login, gh_id, seen_at, node_id) the best per type and lower-case login: an id known first, then the newest, then the larger node id."""
    every = facts[0]
    for f in facts[1:]:
        every = every.unionByName(f)
    rank = F.struct(F.col("gh_id").isNotNull(), F.col("seen_at"), F.col("node_id"))
    return every.where("login <> ''").groupBy("identity_type", F.lower("login").alias("login_key")).agg(F.max_by(F.struct("login", "gh_id", "node_id"), rank).alias("i")).select("identity_type", "login_key", "i.*")


def resolve_identities(owners: DataFrame, identities: DataFrame, org: str = "repo_owner") -> DataFrame:
    """Owners (owner_token, owner_type, repo_owner) with the identity behind them: a user by login, a team only of the repository's owner."""
    name = F.substring("owner_token", 2, 1 << 20)
    team = F.col("owner_type") == "team"
    own = F.lower(F.split(name, "/")[0]) == F.lower(F.col(org))
    key = F.when(F.col("owner_type") == "user", F.lower(name)).when(team & own, F.lower(F.split(name, "/")[1]))
    i = identities.select(F.col("identity_type").alias("i_type"), "login_key", F.col("gh_id").alias("identity_id"))
    out = owners.withColumn("__key", key).join(i, (F.col("__key") == F.col("login_key")) & (F.col("owner_type") == F.col("i_type")), "left")
    return out.select(*owners.columns, "identity_id", F.col("identity_id").isNotNull().alias("resolved"))


def effective_source(candidates: DataFrame) -> DataFrame:
    """(repo_id, path, content, unavailable) to the file that counts: .github before the root before docs; missing, oversized and unavailable are states of their own."""
    rank = F.create_map(*[F.lit(x) for pair in ((".github/CODEOWNERS", 0), ("CODEOWNERS", 1), ("docs/CODEOWNERS", 2)) for x in pair])[F.col("path")]
    # a location that couldn't be read hides what comes after it; one that is absent doesn't
    found = candidates.where(rank.isNotNull() & (F.col("content").isNotNull() | F.col("unavailable")))
    best = found.groupBy("repo_id").agg(F.min_by(F.struct("path", "content", "unavailable"), rank).alias("b"))
    out = candidates.select("repo_id").distinct().join(best, "repo_id", "left")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("b.unavailable"), "unavailable").when(F.octet_length("b.content") >= MAX_SOURCE_BYTES, "oversized").otherwise("present")
    out = out.select("repo_id", state.alias("state"), F.coalesce("b.path", F.lit("")).alias("path"), F.when(state == "present", F.col("b.content")).alias("content"))
    return out.withColumn("source_hash", F.sha2(F.concat_ws("\x1f", "state", "path", F.coalesce("content", F.lit(""))), 256))


def flag_truncated(files: DataFrame, totals: DataFrame) -> DataFrame:
    """Per pull request whether its file list is incomplete: fewer files than announced, or a rename without its old path."""
    got = files.groupBy("repo_id", "pr_number").agg(F.count(F.lit(1)).alias("returned"), F.count_if((F.col("change_type") == "renamed") & F.col("previous_path").isNull()).alias("blind"))
    out = totals.join(got, ["repo_id", "pr_number"], "left")
    return out.select("repo_id", "pr_number", "files_total", F.coalesce("returned", F.lit(0)).alias("returned"), ((F.coalesce("returned", F.lit(0)) != F.col("files_total")) | (F.coalesce("blind", F.lit(0)) > 0)).alias("files_truncated"))
