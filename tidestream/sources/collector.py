"""Lands the datagrams of a UDP port as files, which batch and streaming readers take from there (see packets.landed).

The collector is one process beside Spark. A socket cannot be read again; a landed file can, so what has been landed outlives
failures of the queries. Files appear whole: they are written under a name that readers skip, then renamed.
"""

from __future__ import annotations

import datetime as dt
import socket
import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq

from tidestream import schemas as S
from tidestream.sources import shared

#: Datagrams of a file at most, and seconds after which a file that isn't full is landed.
MOST, SECONDS = 20_000, 1.0
_SCHEMA = pa.schema([("datagram", pa.binary()), ("arrival", pa.timestamp("us", "UTC"))])


def land(rows: list[tuple[bytes, dt.datetime]], folder: str) -> None:
    name = f"{uuid.uuid4().hex}.parquet"
    with shared.create(f"{folder}/_{name}") as out:
        pq.write_table(pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA), out)
    shared.move(f"{folder}/_{name}", f"{folder}/{name}")


def collect(sock: socket.socket, folder: str, seconds: float | None = None, most: int = MOST, every: float = SECONDS) -> int:
    """Lands what comes in at a bound socket, for so many seconds or, with None, for good; how many datagrams came."""
    began = last = time.monotonic()
    held: list[tuple[bytes, dt.datetime]] = []
    came = 0
    sock.settimeout(min(every, 0.2))
    while True:
        try:
            held.append((sock.recv(S.HEADER_BYTES + S.BODY_BYTES + 1), dt.datetime.now(dt.UTC)))
            came += 1
        except TimeoutError:
            pass
        now = time.monotonic()
        over = seconds is not None and now - began >= seconds
        if held and (over or len(held) >= most or now - last >= every):
            land(held, folder)
            held, last = [], now
        if over:
            return came


def listen(port: int, folder: str, host: str = "0.0.0.0", buffer_bytes: int = 64 << 20, **options) -> int:
    """Binds a UDP port, with a receive buffer that bridges the writing of a file, and collects from it."""
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as sock:
        sock.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, buffer_bytes)
        sock.bind((host, port))
        return collect(sock, folder, **options)
