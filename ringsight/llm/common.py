"""Reading, storing and guarding tables; shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ringsight.session import checkpoint_dir

# Word separators of every operator here: space, tab, newline, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []  # folders of stored tables of this process, in order


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Used instead of ``checkpoint()`` for tables read several times: Parquet is compressed and
    later scans read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_so_far() -> int:
    return len(_made)


def remove_stored(spark: SparkSession, since: int) -> None:
    """Delete the tables stored after ``stored_so_far()`` gave ``since``, but the last one.

    For a caller that has stored its result and runs alone in this process: nothing reads the steps before it any more.
    """
    old, _made[since:] = _made[since:-1], _made[-1:] if len(_made) > since else []
    for path in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whole_text(column: str = "text") -> Column:
    """The text, the empty one where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of ``docs`` can't clash with working names."""
    return docs.select(*[docs[n] for n in names])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op=lambda a, b: a + b, block: int = 128) -> Column:
    """What ``op`` makes of all earlier elements (0 at first), for each element of a non-empty int array.

    In two levels: an accumulator that grows with the whole array would cost its square.
    """
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))

    def whole(parts: Column) -> Column:
        heads = grown(F.transform(parts, lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: op(acc, x))))
        inside = F.transform(parts, lambda xs: F.slice(grown(xs), F.lit(1), F.size(xs)))
        joined = F.zip_with(inside, F.slice(heads, F.lit(1), F.size(parts)), lambda xs, head: F.transform(xs, lambda x: op(head, x)))
        return F.flatten(joined)

    return let(values, lambda xs: let(blocks(xs), whole))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
