"""Matrix files and arrays to coo(i, j, v), and back.

Text formats are read split by split: lines or words get their numbers in the whole file, by which pointers, rows and values find each other in joins. Binary
CSC, whose counts are of 32 bits, is read by one task a file. Text sinks write a folder of part files that make the file in order of their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferrule.functions.scan import numbered_lines, numbered_words, prefix_sum

SCHEMA = "i long, j long, v double"
_DATA = "n long, i long, j long, v double"


def _lower(n: int, colptr: np.ndarray, rowind: np.ndarray, nzval: np.ndarray, base: int) -> pd.DataFrame:
    j = np.repeat(np.arange(n), np.diff(colptr))
    i = rowind.astype(np.int64) - base
    keep = i >= j if (i >= j).all() or _symmetric(i, j) else np.ones(len(i), bool)
    i, j, v = np.maximum(i, j)[keep], np.minimum(i, j)[keep], nzval[keep]
    return pd.DataFrame({"n": n, "i": i, "j": j, "v": v.astype(float)})


def _symmetric(i: np.ndarray, j: np.ndarray) -> bool:
    a, b = np.lexsort((j, i)), np.lexsort((i, j))
    return bool((i[a] == j[b]).all() and (j[a] == i[b]).all())


def from_csc(spark: SparkSession, colptr, rowind, nzval, base: int | None = None) -> tuple[DataFrame, int]:
    """Column pointers, rows and values of a lower triangle or a whole symmetric matrix; the base is the first pointer."""
    colptr = np.asarray(colptr, np.int64)
    base = int(colptr[0]) if base is None else base
    pdf = _lower(len(colptr) - 1, colptr - colptr[0], np.asarray(rowind), np.asarray(nzval), base)
    return spark.createDataFrame(pdf[["i", "j", "v"]], SCHEMA), len(colptr) - 1


def _folded(entries: DataFrame) -> DataFrame:
    """The lower triangle of a lower or upper triangle, or of a whole symmetric matrix."""
    low, high = entries.agg(F.count_if(F.col("i") > F.col("j")), F.count_if(F.col("i") < F.col("j"))).first()
    if low and high and low != high:
        raise ValueError("neither a triangle nor symmetric")
    return entries.where("i >= j") if low and high else entries.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "v")


def _from_sections(ptr: DataFrame, row: DataFrame, val: DataFrame | None) -> DataFrame:
    """Entries from pointers, rows and values, each (place, x)."""
    base = int(ptr.where("place = 0").first()["x"])
    ends = ptr.select((F.col("place") - 1).alias("place"), F.col("x").alias("end"))
    columns = ptr.join(ends, "place").where("end > x").select(F.col("place").alias("j"), F.explode(F.sequence(F.col("x") - base, F.col("end") - base - 1)).alias("place"))
    entries = row.select("place", (F.col("x") - base).alias("i")).join(columns, "place")
    entries = entries.withColumn("v", F.lit(1.0)) if val is None else entries.join(val.select("place", F.col("x").alias("v")), "place")
    return _folded(entries.select("i", "j", "v"))


def _real(val: DataFrame, use_abs: bool) -> DataFrame:
    """Complex values, two numbers each, as their real parts or absolute values."""
    pair = val.groupBy(F.floor(F.col("place") / 2).alias("place")).agg(F.sum(F.when(F.col("place") % 2 == 0, F.col("x"))).alias("re"), F.sum(F.when(F.col("place") % 2 == 1, F.col("x"))).alias("im"))
    return pair.select("place", (F.hypot("re", "im") if use_abs else F.col("re")).alias("x"))


def _read_harwell_boeing(spark: SparkSession, path: str, use_abs: bool) -> tuple[DataFrame, int]:
    lines = numbered_lines(spark, path)
    head = [r["value"] for r in lines.where("line < 5").orderBy("line").select("value").collect()]
    totals = [int(x) for x in head[1].split()]
    kind, _, n, nnz = head[2].split()[:4]
    n, nnz, is_complex = int(n), int(nnz), kind[0].upper() == "C"
    forms = re.findall(r"\([^)]*\)", head[3])
    at = 5 if len(totals) > 4 and totals[4] > 0 else 4

    def section(first: int, count: int, form: str, most: int, kind: str) -> DataFrame:
        per, width = map(int, re.search(r"(\d+)\s*[IEDFG]\s*(\d+)", form.upper().replace("1P", "")).groups())
        fields = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: F.trim(F.substring(F.col("value"), k * width + 1, F.lit(width))))
        rows = lines.where((F.col("line") >= first) & (F.col("line") < first + count)).select("line", F.posexplode(fields).alias("k", "f")).where("f <> ''")
        x = F.regexp_replace("f", "[dD]", "E") if kind == "double" else F.col("f")
        return rows.select(((F.col("line") - first) * per + F.col("k")).alias("place"), x.cast(kind).alias("x")).where(F.col("place") < most)

    _, n_ptr, n_row, n_val = totals[:4]
    ptr, row = section(at, n_ptr, forms[0], n + 1, "long"), section(at + n_ptr, n_row, forms[1], nnz, "long")
    if kind[0].upper() == "P" or not n_val:
        return _from_sections(ptr, row, None), n
    val = section(at + n_ptr + n_row, n_val, forms[2], nnz * (2 if is_complex else 1), "double")
    return _from_sections(ptr, row, _real(val, use_abs) if is_complex else val), n


def _read_text(spark: SparkSession, path: str, is_complex: bool, use_abs: bool) -> tuple[DataFrame, int]:
    """n, a number, nnz, a number, then pointers, rows, values."""
    words = numbered_words(numbered_lines(spark, path))
    head = {r["place"]: r["word"] for r in words.where("place < 4").collect()}
    n, nnz = int(head[0]), int(head[2])

    def section(first: int, count: int, kind: str) -> DataFrame:
        return words.where((F.col("place") >= first) & (F.col("place") < first + count)).select((F.col("place") - first).alias("place"), F.col("word").cast(kind).alias("x"))

    val = section(5 + n + nnz, nnz * (2 if is_complex else 1), "double")
    return _from_sections(section(4, n + 1, "long"), section(5 + n, nnz, "long"), _real(val, use_abs) if is_complex else val), n


def parse_binary_csc(raw: bytes, is_complex: bool = False, use_abs: bool = True) -> pd.DataFrame:
    n, nnz, size = np.frombuffer(raw, "<i4", 3)
    at = 12
    ptr = np.frombuffer(raw, "<i4", size, at).astype(np.int64)
    at += 4 * size + 4
    row = np.frombuffer(raw, "<i4", nnz, at)
    at += 4 * int(nnz) + 4
    val = np.frombuffer(raw, "<c16" if is_complex else "<f8", nnz, at)
    val = val if not is_complex else np.abs(val) if use_abs else val.real
    return _lower(int(n), ptr - ptr[0], row, val, int(ptr[0]))


def read_matrix(spark: SparkSession, path: str, fmt: str, is_complex: bool = False, use_abs: bool = False) -> tuple[DataFrame, int]:
    """coo and n of a file: HB, RB or HARWELL_BOEING, CSC, matrix, mm (Matrix Market), parquet. Of complex values the real parts count, or
    the absolute values."""
    kind = fmt.upper()
    if kind == "PARQUET":
        coo = spark.read.parquet(path).select("i", "j", "v")
        return coo, int(coo.agg(F.max("i")).first()[0]) + 1
    if kind in ("HB", "RB", "HARWELL_BOEING"):
        return _read_harwell_boeing(spark, path, use_abs)
    if kind == "MATRIX":
        return _read_text(spark, path, is_complex, use_abs)
    if kind in ("MM", "MTX"):
        lines = numbered_lines(spark, path)
        banner = lines.where("line = 0").first()["value"].lower()
        body = lines.where((F.trim("value") != "") & ~F.col("value").startswith("%")).select("line", F.split(F.trim("value"), r"\s+").alias("x"))
        head = body.orderBy("line").limit(1).first()
        re_, im = (F.coalesce(F.try_element_at("x", F.lit(k)).cast("double"), F.lit(1.0 if k == 3 else 0.0)) for k in (3, 4))
        v = F.hypot(re_, im) if use_abs and "complex" in banner else re_
        coo = body.where(F.col("line") > head["line"]).select((F.col("x")[0].cast("long") - 1).alias("i"), (F.col("x")[1].cast("long") - 1).alias("j"), v.alias("v"))
        return (coo.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "v") if "symmetric" in banner or "hermitian" in banner else _folded(coo)), int(head["x"][0])
    if kind != "CSC":
        raise ValueError(f"unknown matrix format {fmt}")

    def run(frames):
        for f in frames:
            for raw in f["content"]:
                yield parse_binary_csc(bytes(raw), is_complex, use_abs)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _DATA)
    return rows.select("i", "j", "v"), int(rows.agg(F.max("n")).first()[0])


def _sections(coo: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Pointers (place, x) and entries (place, i, v) in column order, both from 1."""
    each = coo.sparkSession.range(n).withColumnRenamed("id", "j").join(coo.groupBy("j").agg(F.count(F.lit(1)).alias("c")), "j", "left").fillna(0, ["c"])
    starts = prefix_sum(each, "j", "c", "start")
    ptr = starts.select(F.col("j").alias("place"), (F.col("start") + 1).alias("x"))
    ptr = ptr.unionByName(starts.where(F.col("j") == n - 1).select((F.col("j") + 1).alias("place"), (F.col("start") + F.col("c") + 1).alias("x")))
    place = F.row_number().over(W.partitionBy("j").orderBy("i")) - 1
    return ptr, coo.withColumn("_r", place).join(starts, "j").select((F.col("start") + F.col("_r")).alias("place"), (F.col("i") + 1).alias("i"), "v")


def _lines(section: int, rows: DataFrame, text: Column, per: int) -> DataFrame:
    """section, line, value: ``text`` of ``rows`` (place, ...), ``per`` to a line."""
    own = rows.select("place", text.alias("t")).groupBy(F.floor(F.col("place") / per).alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), "").alias("value"))
    return own.select(F.lit(section).alias("section"), "line", "value")


def _write_sections(coo: DataFrame, n: int, path: str, header) -> None:
    ptr, entries = _sections(coo, n)
    nnz, per, wide = coo.count(), 8, 3
    head = coo.sparkSession.createDataFrame([(0, k, x) for k, x in enumerate(header(nnz, -(-(n + 1) // per), -(-nnz // per), -(-nnz // wide)))], "section int, line long, value string")
    parts = head.unionByName(_lines(1, ptr, F.format_string("%14d", "x"), per)).unionByName(_lines(2, entries, F.format_string("%14d", "i"), per)).unionByName(_lines(3, entries, F.format_string("%26.16E", "v"), wide))
    parts.repartitionByRange("section", "line").sortWithinPartitions("section", "line").select("value").write.text(path)


def write_harwell_boeing(coo: DataFrame, n: int, path: str, title: str = "matrix") -> None:
    _write_sections(coo, n, path, lambda nnz, p, r, v: [f"{title:<72}key", f"{p + r + v:14d}{p:14d}{r:14d}{v:14d}{0:14d}", f"{'RSA':<14}{n:14d}{n:14d}{nnz:14d}{0:14d}", f"{'(8I14)':<16}{'(8I14)':<16}{'(3E26.16)':<20}"])


def write_text(coo: DataFrame, n: int, path: str) -> None:
    _write_sections(coo, n, path, lambda nnz, *_: [f"{n} 0 {nnz} 0"])


def write_binary_csc(coo: DataFrame, n: int, path: str) -> None:
    """One file ``matrix.csc`` in the folder ``path``, by one task, as the format's pointers stand before all entries and count in 32 bits."""
    from ferrule.operators.store import opened

    name = f"{path}/matrix.csc"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["j", "i"])
        ptr = np.searchsorted(pdf["j"].to_numpy(), np.arange(n + 1)) + 1
        if len(pdf) >= 2**31 - 1:
            raise ValueError("too many entries for 32-bit pointers")
        store, own = opened(name)
        store.create_dir(own.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(own) as f:
            for x in (np.array([n, len(pdf), n + 1]), ptr, np.array([len(pdf)]), pdf["i"].to_numpy() + 1, np.array([len(pdf)])):
                f.write(x.astype("<i4").tobytes())
            f.write(pdf["v"].to_numpy().astype("<f8").tobytes())
        return pd.DataFrame({"n": [len(pdf)]})

    coo.groupBy(F.lit(0).alias("_")).applyInPandas(run, "n long").collect()


def write_matrix_market(coo: DataFrame, n: int, path: str) -> None:
    head = coo.sparkSession.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate real symmetric"), (0, 1, f"{n} {n} {coo.count()}")], "j long, i long, value string")
    body = coo.select((F.col("j") + 1).alias("j"), (F.col("i") + 1).alias("i"), F.format_string("%d %d %.17g", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("value"))
    head.unionByName(body).repartitionByRange("j", "i").sortWithinPartitions("j", "i").select("value").write.text(path)


def matlab_text(coo: DataFrame) -> DataFrame:
    """One line an entry, for ``sparse(I, J, V)``, from 1."""
    return coo.select(F.format_string("%d %d %.17g", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("value"))
