"""Frames from arrays and arrays from frames."""

import numpy as np
import pyarrow as pa


def images(spark, x, parts=3):
    """(n, H, W, C) -> images frame."""
    n, h, w, c = x.shape
    table = pa.table({
        "image_id": pa.array(np.arange(n)),
        "height": pa.array(np.full(n, h, np.int32)),
        "width": pa.array(np.full(n, w, np.int32)),
        "channels": pa.array(np.full(n, c, np.int32)),
        "pixels": pa.array(list(x.reshape(n, -1)), pa.list_(pa.from_numpy_dtype(x.dtype))),
    })
    return spark.createDataFrame(table).repartition(parts)


def maps_array(df, hop):
    """maps frame -> ((n, H, W, C), channel numbers) of one hop."""
    rows = df.filter(f"hop = {hop}").orderBy("channel", "image_id").collect()
    channels = sorted({r.channel for r in rows})
    h, w = rows[0].height, rows[0].width
    v = np.array([r.v for r in rows]).reshape(len(channels), -1, h, w)
    return v.transpose(1, 2, 3, 0), channels


def smooth(rng, n, h, w, c):
    """Images with unlike directions, so that eigenvalues lie apart."""
    base = rng.normal(size=(n, h, w, c))
    return base + 0.7 * np.roll(base, 1, axis=1) + 0.4 * np.roll(base, 1, axis=2) + rng.normal(size=(1, 1, 1, c))
