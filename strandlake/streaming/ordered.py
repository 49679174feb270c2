"""Frame headers of live streams: chunks may arrive in any order, headers leave in order."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes in which every uncompressed header ends, and the place of a stream that has ended.
HEAD, ENDED = 256, -1
OUT = "stream_id string, chunk_idx bigint, sub_idx int, is_key boolean, show_frame boolean, width int, height int, error string"


#: Chunks of a stream that may wait for a missing one.
PATIENCE = 4096


def stream_headers(chunks: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Streaming (stream_id, chunk_idx, data) to frame headers, keyed by stream.

    Micro-batches keep no order, so chunks wait in the stream's state until all before
    them have come; chunks that came before are ignored. Of a waiting chunk the state holds
    the uncompressed headers' bytes only (HEAD of each frame, behind a superframe index of
    its own), so its size doesn't follow the pictures'. There is no watermark: a chunk's time is a
    label, not event time. A stream ends with an error row, and its state shrinks to a
    mark, after a header that can't be parsed and when more than `patience` chunks wait for one
    that hasn't come (MissingChunk).
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        from strandlake.kernel.bits import BitstreamError
        from strandlake.kernel.decoder import Decoder

        following, kept, waiting = 0, None, {}
        if state.exists:
            following, kept, places, heads = state.get
            waiting = {i: bytes(d) for i, d in zip(places, heads, strict=True)}
        decoder = Decoder()
        decoder.kept = pickle.loads(kept) if kept else decoder.kept
        for b in batches:
            if following >= 0:
                waiting |= {i: heads_of(bytes(d)) for i, d in zip(b["chunk_idx"].tolist(), b["data"], strict=True) if i >= following}
        rows = []
        while following >= 0 and waiting:
            error = None
            if following in waiting:
                try:
                    for n, h in enumerate(decoder.headers_only(waiting.pop(following))):
                        rows.append((key[0], following, n, h.key, h.show or h.show_existing is not None, h.width, h.height, None))
                except BitstreamError as e:
                    error = e.kind
            elif len(waiting) > patience:
                error = "MissingChunk"
            else:
                break
            if error:
                rows.append((key[0], following, 0, False, False, 0, 0, error))
                following, waiting = ENDED, {}
            else:
                following += 1
        state.update((following, pickle.dumps(decoder.kept) if following >= 0 else b"", list(waiting), list(waiting.values())))
        yield pd.DataFrame(rows, columns=["stream_id", "chunk_idx", "sub_idx", "is_key", "show_frame", "width", "height", "error"])

    return chunks.select("stream_id", "chunk_idx", "data").groupBy("stream_id").applyInPandasWithState(run, OUT, "following long, kept binary, places array<long>, heads array<binary>", "append", "NoTimeout")


def heads_of(chunk: bytes) -> bytes:
    """A chunk that has the same headers, its frames cut behind them."""
    from strandlake.kernel.headers import join_superframe, split_superframe

    frames = split_superframe(chunk)
    if sum(map(len, frames)) <= HEAD * len(frames):
        return chunk
    return join_superframe([f[:HEAD] for f in frames])
