"""Photometry exports: interleaved LED states, wavelength tables, binary frames, pose and syllable files."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import lerp
from tracelight.operators.intervals import edges_of
from tracelight.operators.joins import bracket
from tracelight.operators.runs import run_length_encode

# LED bits by wavelength in nanometres, and the share of the converter's range that counts as clipped.
LED_BITS = {415: 1, 470: 2, 560: 4}
CLIPPED = 0.98
KEYS = ("subject", "session")


def demultiplex(rows: DataFrame, *, state: str, signal_nm: int, reference_nm: int, rois: list[str], drop_first: bool = False, keys=KEYS) -> DataFrame:
    """Rows that interleave LEDs, as channels on the signal's clock; the reference is interpolated between its own samples.

    A row with several LEDs on is refused by giving no wavelength."""
    led = F.col(state).bitwiseAND(7)
    if drop_first:
        first = rows.groupBy(*keys).agg(F.min("t_us").alias("_first"))
        rows = rows.join(first, list(keys)).where("t_us > _first").drop("_first")
    signal = rows.where(led == LED_BITS[signal_nm])
    reference = rows.where(led == LED_BITS[reference_nm]).select(*keys, "t_us", *rois)
    both = bracket(signal.select(*keys, "t_us", *rois), reference, keys, carry=tuple(rois))
    inside = F.col("b_t_us").isNotNull() & F.col("a_t_us").isNotNull()
    parts = [F.struct(F.lit(r).alias("channel"), F.col(r).alias("signal"), F.when(inside, lerp(F.col("t_us"), F.col("b_t_us"), F.col(f"b_{r}"), F.col("a_t_us"), F.col(f"a_{r}"))).alias("reference")) for r in rois]
    return both.select(*keys, "t_us", F.explode(F.array(*parts)).alias("_c")).select(*keys, "_c.channel", "t_us", (F.col("t_us") / 1e6).alias("t"), "_c.signal", "_c.reference")


def from_wavelength_table(rows: DataFrame, *, rois: list[str], signal_nm: float = 470.0, reference_nm: float = 415.0, keys=KEYS) -> DataFrame:
    """A long table of times, wavelengths and an inclusion flag: excluded rows are missing samples."""
    cleaned = rows.select(*keys, "t_us", "wavelength", *[F.when(F.coalesce(F.col("include"), F.lit(True)), F.col(r)).alias(r) for r in rois])
    state = F.when(F.col("wavelength") == signal_nm, LED_BITS[470]).when(F.col("wavelength") == reference_nm, LED_BITS[415]).otherwise(0)
    return demultiplex(cleaned.withColumn("_state", state), state="_state", signal_nm=470, reference_nm=415, rois=rois, keys=keys)


def digital_events(rows: DataFrame, masks: dict[str, int], *, state: str, edge: str = "rising", keys=KEYS) -> DataFrame:
    """Edges of each flag of a state column as events named by the flag."""
    out = None
    for name, mask in masks.items():
        found = edges_of(rows, F.col(state).bitwiseAND(mask) != 0, keys, edge=edge).select(*keys, "t_us", F.lit(name).alias("condition"), "edge")
        out = found if out is None else out.unionByName(found)
    return out


def parse_frames(content: bytes) -> tuple[dict, pd.DataFrame]:
    """Header and samples of a binary file: a little-endian 16-bit header size, a JSON header, 16-bit words.

    A word's upper 15 bits are the analog value and its lowest bit a digital input. From version 1.1 on, pulsed
    modes alternate a word with the LED on and one with it off for each channel."""
    if len(content) < 2:
        raise ValueError("no header size")
    size = int.from_bytes(content[:2], "little")
    if len(content) < 2 + size:
        raise ValueError("the header is cut off")
    header = json.loads(content[2 : 2 + size])
    rate, scale = float(header["sampling_rate"]), float(header["volts_per_division"][0])
    version = tuple(int(x) for x in str(header["version"]).split(".")[:2])
    mode = str(header["mode"]).lower()
    analog = 2 if version < (1, 0) else int(header["n_analog_signals"])
    digital = 2 if version < (1, 0) else int(header["n_digital_signals"])
    pulsed = ("time div" if version < (1, 0) else "pulsed") in mode
    paired = version >= (1, 1) and pulsed
    payload = content[2 + size :]
    step = analog * (2 if paired else 1)
    if rate <= 0 or analog < 1 or not 0 <= digital <= analog or len(payload) % (2 * step) or not payload:
        raise ValueError("the header does not fit the samples")
    words = np.frombuffer(payload, "<u2").reshape(-1, step)
    volts, bits = (words >> 1) * scale, (words & 1).astype(bool)
    out = {"t_us": np.round(np.arange(len(words)) * 1e6 / rate).astype(np.int64)}
    for k in range(analog):
        if paired:
            on, off = volts[:, 2 * k], volts[:, 2 * k + 1]
            out[f"analog_{k + 1}"] = on - off
            out[f"clipped_{k + 1}"] = np.maximum(on, off) > CLIPPED * float(header["ADC_max_value"]) * scale
        else:
            out[f"analog_{k + 1}"] = volts[:, k]
            out[f"clipped_{k + 1}"] = np.zeros(len(words), bool) if pulsed else volts[:, k] > CLIPPED * (1 << 15) * scale
    for k in range(digital):
        out[f"digital_{k + 1}"] = bits[:, 2 * k if paired else k]
    return header, pd.DataFrame(out)


def load_frames(spark: SparkSession, path: str, *, analog: int = 2, digital: int = 2) -> DataFrame:
    """Samples of all binary files under a path, one task per file: path, t_us, analog, clipped and digital columns."""
    fields = [T.StructField("path", T.StringType()), T.StructField("t_us", T.LongType())]
    for k in range(analog):
        fields += [T.StructField(f"analog_{k + 1}", T.DoubleType()), T.StructField(f"clipped_{k + 1}", T.BooleanType())]
    fields += [T.StructField(f"digital_{k + 1}", T.BooleanType()) for k in range(digital)]
    schema = T.StructType(fields)

    def read(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                _, rows = parse_frames(bytes(content))
                yield rows.reindex(columns=schema.fieldNames()[1:]).assign(path=name)[schema.fieldNames()]

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ppd").load(path).select("path", "content").mapInPandas(read, schema)


def bouts_from_syllables(rows: DataFrame, *, fps: float, keys=KEYS, label: str = "syllable", frame: str = "frame") -> DataFrame:
    """Runs of one syllable as intervals from their first frame to the frame after their last."""
    bouts = run_length_encode(rows, label, keys, order=frame)
    us = 1e6 / fps
    return bouts.select(*keys, F.col(label).cast("string").alias("label"), F.round(F.col("start_us") * us).cast("long").alias("start_us"), F.round((F.col("last_us") + 1) * us).cast("long").alias("stop_us"), "n")


def pose_from_headers(text: str, *, keypoint: str, fps: float, header_rows: int = 3, scorer: str | None = None, individual: str | None = None) -> pd.DataFrame:
    """One keypoint of a table with several header rows (scorer, individual, body part, coordinate); an ambiguous choice is refused."""
    if header_rows not in (3, 4):
        raise ValueError("three or four header rows")
    frame = pd.read_csv(io.StringIO(text), header=list(range(header_rows)), index_col=0)
    levels = ["scorer", *(["individuals"] if header_rows == 4 else []), "bodyparts", "coords"]
    frame.columns = frame.columns.set_names(levels)
    for level, chosen in (("scorer", scorer), ("individuals", individual)):
        if level in levels:
            found = frame.columns.get_level_values(level).unique()
            if chosen is None and len(found) > 1:
                raise ValueError(f"choose one of {level}: {list(found)}")
            frame = frame.xs(chosen or found[0], axis=1, level=level)
    if keypoint not in frame.columns.get_level_values("bodyparts"):
        raise ValueError(f"no keypoint {keypoint!r}")
    part = frame[keypoint]
    return pd.DataFrame({"t_us": np.round(np.arange(len(part)) * 1e6 / fps).astype(np.int64), "x": part["x"].to_numpy(float), "y": part["y"].to_numpy(float), "confidence": part["likelihood"].to_numpy(float)})


def series_reader(kind: str):
    """Readers that need packages this environment may lack: HDF5 and NWB series, TDT blocks."""
    needs = {"doric": "h5py", "nwb": "pynwb", "tdt": "tdt"}
    if kind not in needs:
        raise ValueError(f"unknown kind {kind!r}")
    import importlib

    try:
        return importlib.import_module(needs[kind])
    except ImportError as error:
        raise RuntimeError(f"reading {kind} files needs the package {needs[kind]!r}") from error
