"""The check corpus: code files, texts and pages derived from the given tables.

Every file comes from exactly one input row, so the corpus grows with the tables
and is built without a shuffle.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.templates import TEMPLATES
from riskloom.functions.plan import computed_once
from riskloom.functions.sqltext import constant_list

CONFIG_NAME = ".scan-config.json"
FILES_PER_TASK = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; in CHECK_PARTITIONS parts if the caller names a number.

    The small tables are one row group and so one task; the benchmark asks for more.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = os.environ.get("CHECK_PARTITIONS")
    return rows.repartition(int(parts)) if parts else rows


def dealt(rows: DataFrame) -> DataFrame:
    """Small rows that each become a file, in as many tasks as the files need."""
    if os.environ.get("CHECK_PARTITIONS"):  # the caller has named a number
        return rows
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(tasks, rows.count() // FILES_PER_TASK + 1))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code file per customer: 20 to 60 template lines, some of them odd."""
    k = F.col("c_custkey")
    count = len(TEMPLATES)
    templates = constant_list(TEMPLATES)
    stride = F.when(k % 3 != 0, F.lit(1)).otherwise(1 + (k * 7) % (count - 1))

    def line(i):
        text = F.element_at(templates, ((k * 37 + i * stride) % count + 1).cast("int"))
        text = F.replace(text, F.lit("{v}"), F.concat(F.lit("$v"), ((k + i) % 5).cast("string")))
        return F.replace(
            text, F.lit("{w}"), F.concat(F.lit("$v"), ((k + i * 2) % 5).cast("string"))
        )

    lines = F.transform(F.sequence(F.lit(1), (20 + k % 41).cast("int")), line)
    eol = F.when(k % 10 == 4, F.lit("\r\n")).otherwise(F.lit("\n"))
    content = F.concat(
        F.array_join(lines, "\n"),
        F.when(k % 50 == 9, F.concat(F.lit("\necho $v1; // "), F.repeat(F.lit("a"), 5000),
                                     F.lit(" phpinfo();"))).otherwise(F.lit("")),
        F.when(k % 50 == 11, F.concat(F.lit("\n  $v2 = $_GET['"), F.repeat(F.lit("k"), 300),
                                      F.lit("']; echo $v2;"))).otherwise(F.lit("")),
        # The count depends on the row: a constant megabyte would stand in every copy of the plan.
        F.when(k % 500 == 17, F.concat(F.lit("\n"), F.repeat(F.lit("x"), (k % 500 - 17 + 1048576).cast("int"))))
        .otherwise(F.lit("")),
        F.when(k % 3 == 0, F.lit("\n")).otherwise(F.lit("")),
    )
    folder = (
        F.when(k % 20 == 3, F.lit("vendor/lib"))
        .when(k % 20 == 7, F.lit("node_modules/m"))
        .when(k % 20 == 11, F.lit("tests"))
        .when(k % 20 == 13, F.lit(".git/hooks"))
        .otherwise(F.concat(F.lit("src/m"), (k % 4).cast("string")))
    )
    ext = (
        F.when(k % 12 == 5, F.lit(".PHTML"))
        .when(k % 12 == 6, F.lit(".inc"))
        .when(k % 12 == 9, F.lit(".js"))
        .when(k % 12 == 10, F.lit(".module"))
        .otherwise(F.lit(".php"))
    )
    project = F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))
    rows = computed_once(
        dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")),
        project=project,
        path=F.concat(project, F.lit("/"), folder, F.lit("/f"), k.cast("string"), ext),
        content=F.replace(content, F.lit("\n"), eol),
    )
    return rows.select("project", "path", "content")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("project"),
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".inc")).alias("path"),
        F.col("text").alias("content"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("project"),
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".phtml")).alias("path"),
        F.col("html").alias("content"),
    )
    talk = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("project"),
        F.concat(
            F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit("-"),
            F.col("turn").cast("string"), F.lit(".inc"),
        ).alias("path"),
        F.col("text").alias("content"),
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("project"),
        F.concat(F.lit("benchmark/"), F.col("item_id").cast("string"), F.lit(".inc")).alias("path"),
        F.col("text").alias("content"),
    )
    return docs.unionByName(pages).unionByName(talk).unionByName(items)


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_files(spark, sf_dir).unionByName(text_files(spark, sf_dir))


# -- small project files -----------------------------------------------------------


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest or marker file for each project (one per nation)."""
    n = F.col("n_nationkey")
    project = F.concat(F.lit("p"), n.cast("string"))
    kind = n % 6
    name = F.when(kind == 1, F.lit("wp-config.php")).otherwise(F.lit("composer.json"))
    content = (
        F.when(kind == 0, F.lit('{"name":"x/y","require":{"php":">=8","laravel/framework":"^10.0"}}'))
        .when(kind == 1, F.lit("<?php define('X', 1);"))
        .when(kind == 2, F.lit('{"require":{"symfony/framework-bundle":"6.*","php":"8"}}'))
        .when(kind == 3, F.lit('{"require":{"codeigniter4/framework":"4.1"}}'))
        .when(kind == 4, F.lit('{"require":{"yiisoft/yii2":"2.0","laravel/framework":"^9"}}'))
        .otherwise(F.lit("{not json"))
    )
    return table(spark, sf_dir, "nation").select(
        project.alias("project"), name.alias("path"), content.alias("content"),
    )


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files: at the root of some projects, and below it in others."""
    n = F.col("n_nationkey")
    project = F.concat(F.lit("p"), n.cast("string"))
    root = F.concat(
        F.lit('{"min_severity":"'), F.when(n % 4 == 0, F.lit(" High ")).otherwise(F.lit("bogus")),
        F.lit('","exclude_patterns":["a/*","b"],"concurrency":'), (n % 3 - 1).cast("string"),
        F.lit(',"no_html":true,"json_output":false}'),
    )
    deep = F.concat(
        F.lit('{"context_lines":'), (n % 5).cast("string"),
        F.lit(',"disabled_rules":["X-1"],"output_dir":"out","min_severity":""}'),
    )
    rows = table(spark, sf_dir, "nation").select(
        project.alias("project"), n.alias("n"),
        F.inline(
            F.array(
                F.struct(F.lit("").alias("dir"), root.alias("content")),
                F.struct(F.lit("/src").alias("dir"), deep.alias("content")),
            )
        ),
    )
    kept = rows.where(((F.col("dir") == "") & (F.col("n") % 3 != 1)) | ((F.col("dir") != "") & (F.col("n") % 2 == 0)))
    return kept.select(
        "project", F.concat("project", "dir", F.lit("/" + CONFIG_NAME)).alias("path"), "content"
    )


def relative_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with paths relative to their project; some paths are in several projects."""
    return all_files(spark, sf_dir).withColumn("path", F.substr("path", F.length("project") + 2))


def scan_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files that act on a scan: at the root, in src and in src/m1 of some projects."""
    n = F.col("n_nationkey")
    name = lambda rank: F.element_at(F.array(*[F.lit(x) for x in (" High ", "medium", "", "LOW")]), rank + 1)
    root = F.concat(
        F.lit('{"min_severity":"'), name(n % 4), F.lit('","disabled_rules":["xss-004"],"context_lines":'),
        (n % 5).cast("string"), F.lit("}"),
    )
    src = F.lit('{"exclude_patterns":["src/m2/*","*.module","[^a-f]?.php"],"disabled_rules":["INFO-007"]}')
    deep = F.lit(
        '{"min_severity":"critical","disabled_rules":[" sql-005 "],"exclude_patterns":["f1*"],"show_suppressed":true}'
    )
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), n.cast("string")).alias("project"), n.alias("n"),
        F.inline(F.array(
            F.struct(F.lit("").alias("at"), root.alias("content"), (n % 3 != 1).alias("there")),
            F.struct(F.lit("src/").alias("at"), src.alias("content"), (n % 5 == 2).alias("there")),
            F.struct(F.lit("src/m1/").alias("at"), deep.alias("content"), (n % 2 == 0).alias("there")),
        )),
    )
    return rows.where("there").select("project", F.concat("at", F.lit(CONFIG_NAME)).alias("path"), "content")


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One custom rule file per part; some incomplete, some not JSON."""
    k = F.col("p_partkey")
    name = F.col("p_name")
    severity = (
        F.when(k % 5 == 0, F.lit(" Critical")).when(k % 5 == 1, F.lit("HIGH"))
        .when(k % 5 == 2, F.lit("info")).otherwise(F.lit("odd"))
    )
    content = F.when(k % 11 == 0, F.lit("{broken")).otherwise(
        F.concat(
            F.lit('{"rules":[{"id":"PART-'), k.cast("string"), F.lit('","category":"'),
            F.when(k % 7 == 0, F.lit("")).otherwise(F.col("p_type")),
            F.lit('","severity":"'), severity, F.lit('","cwe":"CWE-1","patterns":["(?i)'), name,
            F.lit('","b+"],"tags":["t1","t2"]},{"id":"X","category":"c","patterns":[]}]}'),
        )
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("rules/part"), k.cast("string"), F.lit(".json")).alias("path"),
        content.alias("content"),
    )


def scan_rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule file per benchmark item, a rule per word of its text; some of them are not valid."""
    k = F.col("item_id")

    def rule(p):
        word = lambda n: F.get("w", p + n)
        pattern = (
            F.when(p % 5 == 0, F.concat(F.lit(r"(?i)\b"), word(0), F.lit(r"\s+"), word(1), F.lit(r"\b")))
            .when(p % 5 == 1, F.concat(word(0), F.lit("[a-z]*[^a-z]+("), word(1), F.lit("|"), word(2), F.lit(")")))
            .when((p % 5 == 2) & (k % 3 == 0), F.concat(F.lit("(?="), word(1), F.lit(")")))
            .when(p % 5 == 2, F.concat(word(1), F.lit("(")))
            .when((p == 3) & (k % 10 == 7), F.concat(F.lit(r"\$v"), (k % 5).cast("string"), F.lit(r"\s*=.*\$_(GET|POST)")))
            .when(p % 5 == 3, F.concat(F.lit("(x"), word(2), F.lit(")?"), word(0), F.lit("{1,2} "), word(1)))
            .when((p == 4) & (k % 20 == 9), F.lit(r"^[A-Z][0-9]{3}\b"))
            .otherwise(F.concat(F.lit(r"\Q"), word(0), F.lit(" "), word(1), F.lit(r"\E")))
        )
        severity = F.element_at(F.array(F.lit("high"), F.lit("Medium"), F.lit("low"), F.lit("info")), (p % 4 + 1).cast("int"))
        return F.struct(
            F.concat(F.lit("ITEM"), k.cast("string"), F.lit("-"), p.cast("string")).alias("id"),
            F.when((p == 3) & (k % 10 == 7), F.lit("SQL Injection"))
            .otherwise(F.concat(F.lit("Words "), (p % 2).cast("string"))).alias("category"),
            severity.alias("severity"), F.array(pattern).alias("patterns"),
        )

    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where(F.size("w") >= 4)
    rules = F.transform(F.sequence(F.lit(0), F.size("w") - 4), rule)
    return items.select(
        F.concat(F.lit("rules/b"), k.cast("string"), F.lit(".json")).alias("path"),
        F.to_json(F.struct(rules.alias("rules"))).alias("content"),
    )


def external_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule of a structural matcher per part."""
    k = F.col("p_partkey")
    pattern = (
        F.when(k % 6 == 0, F.concat(F.lit("f($X, ...,  $VAR_1["), F.col("p_name"), F.lit("])")))
        .when(k % 6 == 1, F.lit("a(...)+b(...){ ... }"))
        .when(k % 6 == 2, F.lit(""))
        .when(k % 6 == 3, F.lit("  $lower->query($SQL . $id) ^ c|d? "))
        .when(k % 6 == 4, F.concat(F.lit("eval(...); "), F.col("p_brand")))
        .otherwise(F.lit("$A = $B...$C"))
    )
    return table(spark, sf_dir, "part").select(
        (k + 1).cast("int").alias("ord"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("ext-"), k.cast("string"))).alias("id"),
        F.col("p_name").alias("message"),
        F.when(k % 3 == 0, F.lit("ERROR")).when(k % 3 == 1, F.lit("warning "))
        .otherwise(F.lit("x")).alias("severity"),
        pattern.alias("pattern"),
        F.when(k % 5 == 0, F.array(F.lit("python"))).otherwise(F.array(F.lit("js"), F.lit("PHP")))
        .alias("languages"),
        F.when(k % 2 == 0, F.lit("CWE-5")).alias("cwe"),
        F.when(k % 3 == 1, F.col("p_type")).otherwise(F.lit("")).alias("category"),
        F.concat(F.lit("ext/"), F.col("p_brand"), F.lit(".yaml")).alias("source_file"),
    )
