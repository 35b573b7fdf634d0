"""Sources and sinks: WAV audio, CSV, two-row CSV headers, JSON protocols, caches, portable paths. Schemas are given, never inferred."""

from __future__ import annotations

import io
import itertools
import platform
import tempfile
import unicodedata
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where all is one machine (a local master). On a cluster that names
    none this raises ValueError."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='refrain-')}"


def evened(df: DataFrame) -> DataFrame:
    """df, dealt over all cores where its files would keep less than a quarter of them busy, as a single row group does. A large input has more parts
    than that, and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def decoder_info() -> dict[str, str]:
    """What decodes audio here, for the keys of caches."""
    return {"decoder": "wave", "python": platform.python_version(), "numpy": np.__version__}


def decode_wav(data: bytes) -> tuple[int, np.ndarray, int]:
    """Rate, samples (by channel if several) of 8, 16, 24 or 32 bits, and the frames that the header names."""
    with wave.open(io.BytesIO(data)) as w:
        rate, width, channels, named = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.getnframes()
        raw = w.readframes(named)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(float) / 2 ** (8 * width - 1)
    elif width == 3:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8).astype(float) / 2**23
    else:
        raise ValueError(f"samples of {width} bytes")
    return rate, x.reshape(-1, channels) if channels > 1 else x, named


def audio(spark: SparkSession, path: str, pattern: str = "*.wav", failures: bool = False) -> DataFrame:
    """recording_id (the file's stem), sample_rate, pcm (mono), duration_s (of what was decoded), container_s (by the header), sha256 and error of audio files.

    A file that can't be decoded fails the read; with failures it is a row with an error and nulls instead. A repeated stem raises ValueError.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("recording_id"), "content", F.sha2("content", 256).alias("sha256"))
    if not named.groupBy("recording_id").count().where("count > 1").isEmpty():
        raise ValueError("two files have the same stem")

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            rows = []
            for name, content, digest in zip(part["recording_id"], part["content"], part["sha256"], strict=True):
                try:
                    rate, x, frames = decode_wav(content)
                except Exception as bad:  # noqa: BLE001
                    if not failures:
                        raise
                    rows.append((name, None, None, None, None, digest, repr(bad)))
                    continue
                mono = x.mean(axis=1) if x.ndim == 2 else x
                rows.append((name, rate, mono.astype(np.float32), len(mono) / rate, frames / rate, digest, None))
            found = pd.DataFrame(rows, columns=["recording_id", "sample_rate", "pcm", "duration_s", "container_s", "sha256", "error"])
            yield found.astype({"sample_rate": "Int32", "duration_s": float, "container_s": float})

    return named.mapInPandas(run, "recording_id string, sample_rate int, pcm array<float>, duration_s double, container_s double, sha256 string, error string")


def same_set(files: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Keys of files without annotation, or of annotations without file: key and side. A complete set has none."""
    one = lambda a, b, side: a.select(key).distinct().join(b, key, "left_anti").withColumn("side", F.lit(side))
    return one(files, annotations, "file").unionByName(one(annotations, files, "annotation"))


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file of texts with a header; a byte order mark before it is no part of the first name."""
    found = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]), enforceSchema=True, multiLine=True, escape='"')
    return found


def csv_two_headers(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """A CSV file whose header has two rows (family, field) and then a row with the name of the index: columns id (six digits) and family_field."""
    names = ["id", *(f"{a}_{b}" for a, b in columns)]
    found = spark.read.csv(path, schema=T.StructType([T.StructField(c, T.StringType()) for c in names]), escape='"', multiLine=True)
    return found.where(F.col("id").rlike("^[0-9]+$")).withColumn("id", F.lpad("id", 6, "0"))


def csv_in_zip(spark: SparkSession, path: str, member: str, columns: list[tuple[str, str]], subsets: tuple[str, ...] = ()) -> DataFrame:
    """As csv_two_headers, from a member of a ZIP archive, with the wanted columns alone, in any order of the file's; with subsets, only rows whose
    set_subset is one of them. An archive is read by one task, row by row."""
    names = ["id", *(f"{a}_{b}" for a, b in columns)]

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv as reader

        for part in stream:
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as raw:
                    lines = reader.reader(io.TextIOWrapper(raw, encoding="utf-8"))
                    heads = list(zip(next(lines), next(lines), strict=True))
                    at = [heads.index(c) for c in columns]
                    next(lines)  # the name of the index
                    while some := list(itertools.islice(lines, 5000)):
                        yield pd.DataFrame([[r[0].zfill(6), *(r[i] for i in at)] for r in some], columns=names)

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    return found.where(F.col("set_subset").isin(*subsets)) if subsets else found


def protocol(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def save_results(predictions: DataFrame, path: str) -> None:
    """By method and duration, each partition replaced as a whole."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "duration_s").parquet(path)


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as none_yet:
        if none_yet.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def cached(spark: SparkSession, path: str, wanted: DataFrame, compute) -> DataFrame:
    """Rows of a feature cache (config_key, source_key, ...) for the wanted keys; what it lacks is computed, and appended."""
    keys = ["config_key", "source_key"]
    held = _held(spark, path)
    missing = wanted if held is None else wanted.join(held.select(keys).distinct(), keys, "left_anti")
    if not missing.isEmpty():
        compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(keys).distinct(), keys, "left_semi")


def extracted(spark: SparkSession, path: str, wanted: DataFrame, compute, provenance: str, batch: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Rows of an extraction that can be resumed, and its failures (source_key, source_sha256, error), for the wanted sources (source_key, source_sha256, ...).

    compute turns wanted sources into rows (source_key, source_sha256, error, ...), a null error where it went well. Rows are appended, some `batch` sources at
    a time, so that what was done before an end counts. Rows of another provenance, or of a source whose digest has changed, aren't used; failures are tried again.
    """
    keys = ["source_key", "source_sha256"]
    held = _held(spark, path)
    good = None if held is None else held.where((F.col("provenance") == provenance) & F.col("error").isNull())
    missing = wanted if good is None else wanted.join(good.select(keys).distinct(), keys, "left_anti")
    parts = -(-missing.count() // batch)
    for i in range(parts):
        some = missing.where(F.pmod(F.xxhash64("source_key"), F.lit(parts)) == i)
        compute(some).withColumn("provenance", F.lit(provenance)).write.mode("append").parquet(path)
    held = _held(spark, path)
    if held is None:
        raise ValueError("nothing is wanted, and nothing was extracted before")
    own = held.where(F.col("provenance") == provenance).join(wanted.select(keys).distinct(), keys, "left_semi")
    good = own.where(F.col("error").isNull())
    failed = own.where(F.col("error").isNotNull()).join(good.select(keys).distinct(), keys, "left_anti")
    return good.drop("provenance", "error"), failed.select(*keys, "error").distinct()


def embeddings(spark: SparkSession, path: str, specification: str) -> DataFrame:
    """A cache of embeddings (specification, ...). Rows of another specification raise an error when they are read."""
    same = F.when(F.col("specification") == specification, F.col("specification")).otherwise(F.raise_error(F.lit("embeddings of another specification")))
    return spark.read.parquet(path).withColumn("specification", same)


def snapshot(spark: SparkSession, path: str, package: str, references: DataFrame, compute) -> DataFrame:
    """(reference_key, t, hash) of an index of hashes, kept by package version, path and size of each reference (reference_key, path, size): compute gives those that
    are not kept, or were with another package, path or size."""
    keyed = references.withColumns({"config_key": F.lit(package), "source_key": cache_key(F.col("path"), F.col("size").cast("string"))})
    found = cached(spark, path, keyed, lambda missing: compute(missing).join(missing.select("reference_key", "config_key", "source_key"), "reference_key"))
    return found.select("reference_key", "t", "hash")


def cache_key(*parts: Column, digits: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, digits)


def portable(path: Column, root: str) -> Column:
    """A path below root as one relative to it, with slashes."""
    slashes = F.replace(path, F.lit("\\"), F.lit("/"))
    head = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(slashes.startswith(head), F.substring(slashes, F.lit(len(head) + 1), F.length(slashes))).otherwise(slashes)


def materialised(path: Column, root: str) -> Column:
    """A relative path below root again; an absolute one, or one that leaves the root, raises an error."""
    bad = path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    return F.when(bad, F.raise_error(F.concat(F.lit("not a portable path: "), path))).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


#: Fields of protocols that hold paths; fixed values.
PATH_KEYS = ("path", "cache", "model_path", "fit_protocol_path", "root")


def with_portable(rows: DataFrame, root: str, keys: tuple[str, ...] = PATH_KEYS) -> DataFrame:
    """rows, with portable paths in every text field of such a name, however deep in structures and arrays."""

    def rewritten(value: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StringType):
            return portable(value, root) if name in keys else value
        if isinstance(kind, T.StructType):
            fields = [rewritten(value[f"`{f.name}`"] if "." in f.name else value[f.name], f.dataType, f.name).alias(f.name) for f in kind]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: rewritten(x, kind.elementType, name))
        return value

    return rows.select(*(rewritten(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in rows.schema))


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold())


def creator_key(rows: DataFrame, column: str, name: str = "creator_key") -> DataFrame:
    """rows, with the column NFKC-normalised, stripped and case-folded. Only that column goes to Python."""
    return rows.withColumn(name, _folded(F.col(column)))


def pcm_crop(pcm: Column, rate: Column, start_s: Column, seconds: Column, slack: int = 5) -> Column:
    """Samples from round(start * rate) on, halves to even; null where more than `slack` are missing."""
    n = F.rint(seconds * rate).cast("int")
    found = F.slice(pcm, F.rint(start_s * rate).cast("int") + 1, n)
    return F.when(F.size(found) >= n - slack, found)


def save_crops(crops: DataFrame, path: str, seconds: float, slack: int = 5) -> DataFrame:
    """crops (pcm, sample_rate, ...), written and read back. A crop whose length is off by more than `slack` samples raises an error."""
    off = F.abs(F.size("pcm") - F.rint(F.lit(seconds) * F.col("sample_rate"))) > slack
    checked = F.when(off, F.raise_error(F.lit("a crop has another length"))).otherwise(F.col("pcm"))
    crops.withColumn("pcm", checked).write.mode("overwrite").parquet(path)
    return crops.sparkSession.read.schema(crops.schema).parquet(path)


def boundary_variants(signals: DataFrame) -> DataFrame:
    """signals (pcm, sample_rate, expected_start, scale), once for each digital boundary: unchanged, half a second or a second of silence before, a second less; the expected start moves with it."""
    rate, p = F.col("sample_rate"), F.col("pcm")
    quiet = lambda s: F.array_repeat(F.lit(0.0).cast("float"), (rate * s).cast("int"))
    forms = [("unchanged", p, 0.0), ("lead_half", F.slice(F.concat(quiet(0.5), p), F.lit(1), F.size(p)), -0.5), ("lead_one", F.slice(F.concat(quiet(1.0), p), F.lit(1), F.size(p)), -1.0), ("trim_one", F.slice(p, (rate + 1).cast("int"), F.greatest(F.size(p) - rate, F.lit(0)).cast("int")), 1.0)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("condition"), x.alias("pcm"), F.lit(d).alias("moved")) for n, x, d in forms))).alias("form")
    others = [c for c in signals.columns if c not in ("pcm", "expected_start")]
    return signals.select(*others, "expected_start", each).select(*others, "form.condition", "form.pcm", (F.col("expected_start") + F.col("form.moved") * F.col("scale")).alias("expected_start"))


def perturbations(signals: DataFrame, conditions: list[str], seed: str) -> DataFrame:
    """signals (recording_id, sample_rate, pcm, ...), once for each condition, with pcm so changed. The noise and lost packets of a recording follow from the digest of
    seed, recording and condition, whatever the partitions. Columns beside these three go through Python too."""
    each = signals.withColumn("condition", F.explode(F.lit(conditions).cast("array<string>")))
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "recording_id", "condition"), 256), 1, 15), 16, 10).cast("bigint")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def changed(pcm: pd.Series, rate: pd.Series, condition: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else perturbed(np.asarray(x), int(r), c, int(s)).astype(np.float32) for x, r, c, s in zip(pcm, rate, condition, own, strict=True)])

    return each.withColumn("pcm", changed("pcm", "sample_rate", "condition", number))


def perturbed(pcm: np.ndarray, rate: int, condition: str, seed: int) -> np.ndarray:
    """A condition of the speech study: clean, gain_up, gain_down, clip, noise, preemphasis, tilt_up, tilt_down, packets. MP3 coding has no codec here and raises ValueError."""
    x, random = np.asarray(pcm, float), np.random.default_rng(seed)
    if condition == "clean":
        return x
    if condition in ("gain_up", "gain_down"):
        return x * 10 ** ((6 if condition == "gain_up" else -6) / 20)
    if condition == "clip":
        top = 0.4 * np.abs(x).max(initial=0)
        return np.clip(x, -top, top)
    if condition == "noise":
        noise = random.standard_normal(len(x))
        power = lambda y: float((y * y).mean()) if len(y) else 0.0
        return x + noise * np.sqrt(power(x) / 10 / max(power(noise), 1e-300))
    if condition == "preemphasis":
        return np.concatenate([x[:1], x[1:] - 0.9 * x[:-1]])
    if condition in ("tilt_up", "tilt_down"):
        spectrum = np.fft.rfft(x)
        ramp = np.linspace(-6, 6, len(spectrum)) * (1 if condition == "tilt_up" else -1)
        return np.fft.irfft(spectrum * 10 ** (ramp / 20), len(x))
    if condition == "packets":
        size = rate // 50
        packets = -(-len(x) // size)
        lost = np.zeros(packets, bool)
        lost[random.choice(packets, packets // 10, replace=False)] = True  # exactly a tenth
        return np.where(np.repeat(lost, size)[: len(x)], 0.0, x)
    raise ValueError(f"unknown condition {condition}")
