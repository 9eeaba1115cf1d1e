"""Log audits over conversation tables.

``conversations(conv_id, turn, role, text)``: one row per message. All
extraction is JVM-side regex; set differences are anti joins.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# URL pattern and the trailing punctuation stripped from a match.
URL_PATTERN = r"https?://\S+"

# Fenced python block languages and common bare aliases.
FENCE_PATTERN = r"(?is)```(?:python|py|py3|ipython|jupyter)?\s*\n(.*?)```"
# a statement begins a line or follows ; or : - "import" takes a list, "from" one module
IMPORT_PATTERN = r"(?m)(?:^|[;:])[ \t]*import[ \t]+([^\n;#]+)"
FROM_PATTERN = r"(?m)(?:^|[;:])[ \t]*from[ \t]+([A-Za-z_][A-Za-z0-9_]*)"
MODULE_PATTERN = r"^\s*([A-Za-z_][A-Za-z0-9_]*)"
# Cell magics whose cells hold Python.
PYTHON_MAGICS = "time|timeit|capture|prun|python|python3|py"
OTHER_MAGIC_PATTERN = rf"^\s*%%(?!(?:{PYTHON_MAGICS})\b)"
COMMON_ALIASES = {"pd": "pandas", "np": "numpy", "plt": "matplotlib", "sns": "seaborn", "tf": "tensorflow",
                  "xgb": "xgboost", "lgb": "lightgbm", "jnp": "jax", "torch": "torch", "sklearn": "sklearn"}
DEFAULT_TRUSTED = ("ranklab", "pyspark")


# Trailing punctuation as a regex: strip a final run of any of URL_TRAILING.
URL_TRAILING_RX = r"""[.,;:!?)>\]}"']+$"""


def extract_urls(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, role, url) with trailing punctuation removed."""
    urls = conv.select("conv_id", "turn", "role",
                       F.explode(F.regexp_extract_all("text", F.lit(URL_PATTERN), 0)).alias("raw"))
    return urls.withColumn("url", F.regexp_replace("raw", URL_TRAILING_RX, "")).drop("raw")


def novel_urls(conv: DataFrame, assistant_role: str = "assistant", user_role: str = "user") -> DataFrame:
    """URLs in an assistant turn that the user did not type earlier in the same conversation.

    Anti join on (conv_id, url) with the condition ``user_turn <= assistant_turn``.
    """
    u = extract_urls(conv)
    said = u.filter(F.col("role") == assistant_role).select("conv_id", "turn", "url").distinct()
    typed = u.filter(F.col("role") == user_role).select("conv_id", F.col("turn").alias("_ut"),
                                                         F.col("url").alias("_uurl"))
    cond = [said.conv_id == typed.conv_id, said.url == typed._uurl, typed._ut <= said.turn]
    return said.join(typed, cond, "left_anti")


def novel_url_counts(conv: DataFrame, assistant_role: str = "assistant") -> DataFrame:
    """Per conversation: assistant turns, URLs mentioned, novel URLs (0 when none)."""
    nov = novel_urls(conv, assistant_role).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_novel_urls"))
    urls = extract_urls(conv).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_urls"))
    base = conv.groupBy("conv_id").agg(F.count_if(F.col("role") == assistant_role).alias("n_assistant_turns"))
    return (base.join(urls, "conv_id", "left").join(nov, "conv_id", "left")
            .fillna(0, subset=["n_urls", "n_novel_urls"]))


def foreign_references(conv: DataFrame, trusted: Sequence[str] = DEFAULT_TRUSTED,
                       text_col: str = "text") -> DataFrame:
    """D5 (regex re-aim): package roots referenced in fenced Python blocks that are
    neither standard library nor trusted. Imports come from ``import x, y as z`` lists and
    ``from x`` statements, also after ``;`` and ``:``; bare aliases from ``alias.`` uses (``pd.`` -> pandas). Blocks that a cell magic
    gives to another language (``%%bash``, ``%%html``) are not Python and are left out.
    Output (conv_id, turn, package)."""
    blocks = conv.select("conv_id", "turn", F.explode(F.regexp_extract_all(text_col, F.lit(FENCE_PATTERN), 1))
                         .alias("block")).filter(~F.col("block").rlike(OTHER_MAGIC_PATTERN))
    listed = F.flatten(F.transform(F.regexp_extract_all("block", F.lit(IMPORT_PATTERN), 1), lambda x: F.split(x, ",")))
    names = F.concat(F.transform(listed, lambda x: F.regexp_extract(x, MODULE_PATTERN, 1)), F.regexp_extract_all("block", F.lit(FROM_PATTERN), 1))
    imports = blocks.select("conv_id", "turn", F.explode(names).alias("package")).filter("package <> ''")
    alias_rx = r"(?:^|[^A-Za-z0-9_.])(" + "|".join(COMMON_ALIASES) + r")\."
    alias_map = F.create_map(*[x for kv in COMMON_ALIASES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    aliases = blocks.select("conv_id", "turn",
                            F.explode(F.regexp_extract_all("block", F.lit(alias_rx), 1)).alias("alias")) \
        .select("conv_id", "turn", alias_map[F.col("alias")].alias("package"))
    stdlib = sorted(getattr(sys, "stdlib_module_names", ()))
    skip = set(stdlib) | set(trusted)
    both = imports.unionByName(aliases)
    return both.filter(~F.col("package").isin(list(skip))).distinct()


def foreign_reference_counts(conv: DataFrame, trusted: Sequence[str] = DEFAULT_TRUSTED) -> DataFrame:
    """Per conversation: messages with fenced blocks, and distinct foreign packages."""
    fences = conv.groupBy("conv_id").agg(
        F.count_if(F.size(F.regexp_extract_all("text", F.lit(FENCE_PATTERN), 1)) > 0).alias("n_code_messages"))
    foreign = foreign_references(conv, trusted).groupBy("conv_id").agg(
        F.countDistinct("package").alias("n_foreign_packages"))
    return fences.join(foreign, "conv_id", "left").fillna(0, subset=["n_foreign_packages"])


def last_failure_per_model(failures: DataFrame) -> DataFrame:
    """D3: latest failure row per model (``max_by`` on the timestamp)."""
    cols = [c for c in failures.columns if c != "model_id"]
    return failures.groupBy("model_id").agg(F.max_by(F.struct(*cols), F.col("ts")).alias("_r")) \
        .select("model_id", "_r.*")


def retries_per_model(failures: DataFrame, max_retries: int = 2) -> DataFrame:
    """D3: retries (failures with a fix applied) per model; retry allowed while < max_retries."""
    return failures.groupBy("model_id").agg(F.count_if(F.col("fix").isNotNull()).alias("retries")) \
        .withColumn("retry_allowed", F.col("retries") < max_retries)


def untried_fixes(fixes: DataFrame, failures: DataFrame) -> DataFrame:
    """D3: candidate fixes per (model, category) not yet attempted (anti join on the fix signature)."""
    tried = failures.filter(F.col("fix").isNotNull()).select("model_id", F.col("fix").alias("signature"))
    return fixes.join(tried, ["model_id", "signature"], "left_anti")
