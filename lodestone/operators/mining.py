"""From commits to evaluation tasks: the rules that keep or reject a commit, and the gold files of those kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.paths import is_ci_config, is_docs, is_lockfile, is_source, is_test_path
from lodestone.functions.text import clean_task_text, word_count, words_in
from lodestone.sources.shared import written

MAX_FILES, MAX_WORDS, MIN_WORDS = 8, 200, 5


def is_bot(name: Column, email: Column) -> Column:
    who = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(email, F.lit(""))))
    return F.exists(words_in(*config.BOT_MARKS), lambda b: F.contains(who, b))


def content_only(files: Column) -> Column:
    """Why files hold no source: lockfile-only, docs-only, ci-only; null if they might."""
    paths = F.filter(F.flatten(F.transform(files, lambda f: F.array(f["pre_path"], f["post_path"]))), lambda p: p.isNotNull() & (p != ""))
    kind = lambda p: F.when(is_lockfile(p), "lock-only").when(is_docs(p), "docs-only").when(is_ci_config(p), "ci-only").otherwise("other-asset-only")
    kinds = F.array_distinct(F.transform(paths, kind))
    return (
        F.when(F.exists(paths, lambda p: is_source(p) | is_test_path(p)), None).when(F.array_contains(kinds, "lock-only"), "lockfile-only")
        .when((F.size(kinds) == 1) & ~F.array_contains(kinds, "other-asset-only"), F.element_at(kinds, 1))
    )


def judge(commits: DataFrame) -> DataFrame:
    """commits: sha, parents, author_name, author_email, subject, body, files. Adds task, gold, excluded_new_files
    and reason (null if the commit is kept). The first rule that a commit breaks is its reason."""
    files, subject = F.col("files"), F.col("subject")
    made = F.filter(files, lambda f: f["status"].isin("A", "C"))
    gold = F.array_sort(F.array_distinct(F.transform(F.filter(files, lambda f: ~f["status"].isin("A", "C")), lambda f: F.translate(f["pre_path"], "\\", "/"))))
    d = commits.withColumns({"task": clean_task_text(subject, F.col("body")), "gold": gold, "excluded_new_files": F.size(made)})
    d = d.withColumn("n_words", word_count(F.col("task")))
    version_files = F.forall(files, lambda f: F.lower(f["post_path"]).endswith("package.json") | F.lower(f["post_path"]).endswith("tsconfig.json") | is_lockfile(f["post_path"]))
    reason = (
        F.when(F.size("parents") != 1, "merge-commit")
        .when(is_bot(F.col("author_name"), F.col("author_email")), "bot-author")
        .when(F.size(files) == 0, "file-count")
        .when(F.forall(files, lambda f: f["status"].startswith("R")), "pure-rename")
        .when(F.size("gold") == 0, "no-localizable-gold")
        .when(F.size(files) > MAX_FILES, "file-count")
        .when(F.col("n_words") > MAX_WORDS, "task-too-long")
        .when(subject.rlike(config.REVERT_SUBJECT), "revert")
        .when(subject.rlike(config.VERSION_SUBJECT) & version_files, "version-bump")
        .when(subject.rlike(config.FORMAT_SUBJECT) & F.forall(files, lambda f: ~is_source(f["pre_path"])), "format-only")
        .when(content_only(files).isNotNull(), content_only(files))
        .when(~F.exists(files, lambda f: is_source(f["pre_path"]) | is_source(f["post_path"])), "no-source-file")
        .when(F.col("n_words") < MIN_WORDS, "task-too-short")
    )
    return d.withColumn("reason", reason)


def funnel(judged: DataFrame, by: list[str] = ()) -> DataFrame:
    """Commits for each reason; those kept under ``kept``."""
    return judged.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def first_of_text(tasks: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row of each text: the first in ``order``. Aggregated before the shuffle, so copies by the thousand cost little."""
    return tasks.groupBy(text).agg(F.min(F.struct(*order, *[c for c in tasks.columns if c not in (text, *order)])).alias("x")).select(text, "x.*")


def mode_gold(tasks: DataFrame, trees: DataFrame) -> DataFrame:
    """tasks: task_id, parent_sha, gold; trees: parent_sha, path, mode. Adds to each gold file what the parent's
    tree says: task_id, path, fate (kept, symlink, gitlink, missing). A dropped script is an error."""
    g = tasks.select("task_id", "parent_sha", F.explode("gold").alias("path")).join(trees.select("parent_sha", "path", "mode"), ["parent_sha", "path"], "left")
    fate = F.when(F.col("mode").isin("100644", "100755"), "kept").when(F.col("mode") == "120000", "symlink").when(F.col("mode") == "160000", "gitlink").otherwise("missing")
    script = (fate != "kept") & F.col("path").rlike(r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs)$")
    checked = F.when(script, F.raise_error(F.concat(F.lit("a script would be dropped from the gold of "), F.col("task_id").cast("string"))).cast("string")).otherwise(fate)
    return g.select("task_id", "path", checked.alias("fate"))


def mode_stats(fates: DataFrame) -> DataFrame:
    """One row: tasks kept, dropped and cut, and files dropped by cause."""
    per = fates.groupBy("task_id").agg(F.count_if(F.col("fate") == "kept").alias("kept"), *[F.count_if(F.col("fate") == f).alias(f) for f in ("symlink", "gitlink", "missing")])
    lost = F.col("symlink") + F.col("gitlink") + F.col("missing") > 0
    return per.agg(
        F.count_if(F.col("kept") > 0).alias("evaluated_tasks"), F.count_if(F.col("kept") == 0).alias("tasks_dropped_empty_gold"), F.count_if((F.col("kept") > 0) & lost).alias("tasks_with_partial_drop"),
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f"dropped_{f}") for f in ("symlink", "gitlink", "missing")],
    )


def dataset_hash(tasks: list[list]) -> int:
    """A fingerprint of a dataset: FNV-1a over its compact JSON."""
    import json

    from lodestone.operators.stats import fnv1a

    return fnv1a(json.dumps(tasks, separators=(",", ":"), ensure_ascii=False))


def candidates(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept commits, one for each task text and repository, written once; and the place of each within its repository by time
    (repo_id, committer_time, sha, _r, _n)."""
    from lodestone.operators.ranks import group_rank

    kept = judge(commits).filter("reason is null")
    first = kept.groupBy("repo_id", "task").agg(F.min(F.struct("committer_time", "sha", "parent_sha", "gold", "excluded_new_files")).alias("x")).select("repo_id", "task", "x.*")
    first = written(first, "candidates")
    return first, written(group_rank(first.select("repo_id", "committer_time", "sha"), "repo_id", ["committer_time", "sha"], "_r", "_n"), "places")


def assemble(commits: DataFrame, per_repo: int, seed: int, half: str = "eval", among: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """commits (with repo_id, parent_sha, committer_time): kept, one for each task text and repository, of the wanted half by time, sampled.
    among: what ``candidates`` gave, if it is at hand."""
    from lodestone.operators.stats import sample_places

    first, places = candidates(commits) if among is None else among
    early = F.floor(F.col("_n") / 2)
    pool = places.filter((F.col("_r") > early) == F.lit(half == "eval")).withColumn("place", F.col("_r") - (early if half == "eval" else F.lit(0)))
    picked = pool.join(sample_places(pool.groupBy("repo_id").agg(F.count("*").alias("n")), per_repo, seed), ["repo_id", "place"], "left_semi")
    return first.join(picked.select("repo_id", "sha"), ["repo_id", "sha"], "left_semi").withColumn("task_id", F.concat("repo_id", F.lit(":"), "sha"))


def splits(commits: DataFrame, per_repo: int, tuning_per_repo: int, holdout_per_repo: int, seed: int) -> DataFrame:
    """The tasks of all three sets, with their ``split``. ``eval`` is drawn from the later half by time, ``tuning`` from the earlier;
    ``holdout`` is what a longer draw from the later half has beyond ``eval``. A longer draw begins as the shorter one
    does; if it should not hold all of it, the job fails."""
    among = candidates(commits)
    drawn = written(assemble(commits, per_repo + holdout_per_repo, seed, among=among), "drawn")
    own = written(assemble(commits, per_repo, seed, among=among), "eval")
    if not own.join(drawn, "task_id", "left_anti").isEmpty():
        raise ValueError("the holdout draw does not contain the eval sample")
    rest = drawn.join(own.select("task_id"), "task_id", "left_anti").select(*own.columns)
    tuning = assemble(commits, tuning_per_repo, seed, "tuning", among)
    named = lambda d, name: d.withColumn("split", F.lit(name))
    return named(own, "eval").unionByName(named(rest, "holdout")).unionByName(named(tuning, "tuning"))
