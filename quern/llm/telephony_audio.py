"""Telephony audio columns: mu-law, A-law and ADPCM to resampled PCM.

Method: companded samples are expanded by tables of 256 entries; blocks of
IMA ADPCM are decoded sample by sample with numpy across all blocks of a batch;
the PCM is resampled by linear interpolation and stored as a WAVE file. The
tables are built from the formulas of the public standards (ITU-T G.711, IMA).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.text_bytes import chunks

#: Format tags of WAVE files.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
RATE = 8000
#: Bytes of an ADPCM block: 4 of header, two samples in each other.
BLOCK = 64
UNIT = 64
#: Rates that are taken for real; others would blow a file up.
LEAST_RATE, MOST_RATE = 1000, 384_000


def mu_law_table() -> np.ndarray:
    """Linear 16-bit sample of each mu-law byte."""
    code = ~np.arange(256) & 255
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """Linear 16-bit sample of each A-law byte."""
    code = np.arange(256) ^ 85
    part, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, step + 8, (step + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm_steps() -> np.ndarray:
    """The 89 step sizes: each a tenth above the one before, from 7, as IMA's fixed table lists them."""
    # fmt: off
    # Fixed values of the IMA ADPCM standard.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ])
    # fmt: on


MU, A, STEPS = mu_law_table(), a_law_table(), adpcm_steps()
TURNS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Rows of one mono IMA ADPCM block each -> rows of 16-bit samples, 2 * (bytes - 4) + 1 of them."""
    blocks = blocks.astype(np.int32)
    value = ((blocks[:, 0] | blocks[:, 1] << 8) ^ 32768) - 32768
    index = np.minimum(blocks[:, 2], 88)
    out = np.empty((len(blocks), 2 * (blocks.shape[1] - 4) + 1), np.int16)
    out[:, 0] = value
    for k in range(out.shape[1] - 1):
        code = blocks[:, 4 + k // 2] >> 4 * (k % 2) & 15
        step = STEPS[index]
        move = (step >> 3) + (code & 1) * (step >> 2) + (code >> 1 & 1) * (step >> 1) + (code >> 2 & 1) * step
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + TURNS[code], 0, 88)
        out[:, k + 1] = value
    return out


def encode_adpcm(samples: np.ndarray, block: int = BLOCK) -> bytes:
    """16-bit samples -> IMA ADPCM blocks; the last one is filled up with its last sample."""
    per = 2 * (block - 4) + 1
    n = max(1, -(-len(samples) // per))
    rows = np.pad(samples.astype(np.int32), (0, n * per - len(samples)), mode="edge" if len(samples) else "constant").reshape(n, per)
    out = np.zeros((n, block), np.uint8)
    value, index = rows[:, 0].copy(), np.zeros(n, np.int64)
    out[:, 0], out[:, 1] = value & 255, value >> 8 & 255
    for k in range(per - 1):
        step = STEPS[index]
        off = rows[:, k + 1] - value
        rest, code = np.abs(off), np.where(off < 0, 8, 0)
        move = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = rest >= part
            code, rest, move = code | on * bit, rest - on * part, move + on * part
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + TURNS[code], 0, 88)
        out[:, 4 + k // 2] |= (code << 4 * (k % 2)).astype(np.uint8)
    return out.tobytes()


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation of 16-bit samples at another rate."""
    if rate == to or not len(samples):
        return samples
    at = np.arange(-(-len(samples) * to // rate)) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(samples) - 1)
    x = samples.astype(np.int64)
    return ((x[left] * (to - part) + x[right] * part) // to).astype(np.int16)


def wave_file(data: bytes, tag: int, rate: int = RATE, bits: int = 8, block: int = 1) -> bytes:
    """A mono WAVE file around stored samples."""
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    per_second = rate * block // (2 * (block - 4) + 1) if tag == IMA_ADPCM else rate * block
    head = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and stored samples of a mono WAVE file; ValueError if it is none or has no real rate."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if channels != 1 or not LEAST_RATE <= rate <= MOST_RATE:
                raise ValueError(f"{channels} channels at a rate of {rate}")
            form = tag, rate, block
        elif name == b"data" and form:
            return *form, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without samples")


def expand(tag: int, block: int, data: bytes) -> np.ndarray:
    """16-bit samples of stored ones."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MU_LAW:
        return MU[raw]
    if tag == A_LAW:
        return A[raw]
    if tag == IMA_ADPCM and block > 4:
        return decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    if tag == PCM and block in (1, 2):
        return raw.view("<i2").astype(np.int16) if block == 2 else ((raw.astype(np.int16) - 128) << 8)
    raise ValueError(f"unknown format {tag} in blocks of {block}")


def to_pcm(media: DataFrame, media_col: str = "media", rate: int = 2 * RATE) -> DataFrame:
    """Adds ``pcm``, the telephony files of ``media_col`` as 16-bit PCM WAVE files at ``rate``.

    Null stays null, and what is no mono WAVE file of a known format gives null,
    as do a block size or a rate that can't be; a file without samples gives one
    without samples, an unfinished block at the end is left out. Repeated rows
    are converted alike, an empty table stays empty. A file and its PCM, some
    eight times its size, are held in memory one at a time. Other columns stay,
    an older ``pcm`` column is replaced.
    """

    @F.pandas_udf("binary")
    def convert(files):
        def one(file):
            try:
                tag, own, block, data = read_wave(bytes(file))
                return wave_file(resample(expand(tag, block, data), own, rate).astype("<i2").tobytes(), PCM, rate, 16, 2)
            except (TypeError, ValueError, struct.error):
                return None

        return files.map(one)

    return media.withColumn("pcm", convert(media_col))


def _features(payloads: list[bytes], pcms: list[bytes]) -> list[str]:
    """Loudness and zero crossings by each decoder, and length and checksum of the resampled PCM."""
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum([len(p) for p in payloads])
    adpcm = np.split(decode_adpcm(flat.reshape(-1, BLOCK)), ends[:-1] // BLOCK)
    out = []
    for p, x, pcm in zip(payloads, adpcm, pcms, strict=True):
        raw = np.frombuffer(p, np.uint8)
        mu, a = MU[raw], A[raw]
        level = [int(np.sqrt(np.mean(np.square(s, dtype=np.float64)))) for s in (mu, a, x)]
        crossings = int(np.count_nonzero((mu[1:] < 0) != (mu[:-1] < 0)))
        out.append(f"mu_rms={level[0]};a_rms={level[1]};adpcm_rms={level[2]};crossings={crossings};pcm16k_samples={len(pcm) // 2};pcm16k_crc32={zlib.crc32(pcm)}")
    return out


def _stored(texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Texts, filled up to whole units, as mu-law files, and these resampled as PCM files."""
    media = [wave_file(t + b"\0" * (max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t)), MU_LAW) for t in texts]
    pcm = [wave_file(resample(expand(tag, block, data), rate, 2 * RATE).astype("<i2").tobytes(), PCM, 2 * RATE, 16, 2) for tag, rate, block, data in map(read_wave, media)]
    return media, pcm


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts in UTF-8, about a megabyte at a time."""
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(1)):
            whole = data.tobytes()
            yield batch.column(0).slice(first, end - first), [whole[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _texts(batches):
        media, pcm = _stored(texts)
        yield pa.RecordBatch.from_arrays([ids, pa.array(media, pa.binary()), pa.array(pcm, pa.binary())], ["id", "media", "pcm"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _texts(batches):
        media, pcm = _stored(texts)
        payloads = [read_wave(m)[3] for m in media]
        columns = [
            ids,
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([len(p) for p in payloads], pa.int64()),
            pa.array([sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()),
            pa.array([len(m) for m in media], pa.int64()),
            pa.array([sha256(m).hexdigest() for m in media]),
            pa.array(_features(payloads, [read_wave(m)[3] for m in pcm])),
            pa.array([len(m) for m in pcm], pa.int64()),
            pa.array([sha256(m).hexdigest() for m in pcm]),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"])


def media_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, media, pcm``: every whole text as a mu-law WAVE file, and that resampled to 16-bit PCM as another.

    Texts are stored and odd rows treated as by :func:`text_media`.
    """
    return _of_texts(docs, id_col, text_col, _files, "media binary, pcm binary")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as a mu-law WAVE file, read back and measured, and what its resampled PCM file is.

    The UTF-8 bytes, filled up with bytes 0 to a positive multiple of 64, are
    stored as mu-law samples. Null counts as empty: one unit of zeros. Equal
    texts have equal values, so repeated rows are measured alike; an empty table
    gives an empty one, a null id stays null. A very long text takes some 30
    times its size of memory by itself. Other columns are ignored.
    """
    figures = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return _of_texts(docs, id_col, text_col, _digests, figures)


def _of_texts(docs: DataFrame, id_col: str, text_col: str, run, columns: str) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
