"""Tasks that run side by side and add up arrays round by round, with no job of Spark's a round."""

from __future__ import annotations

import secrets
import socket
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

#: Seconds that a task waits for another one; then the stage fails and is tried again.
PATIENCE = 900


def slots(spark: SparkSession) -> int:
    """How many tasks run at a time; 1 where a barrier stage can't be had (dynamic allocation)."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    inner = sc._jsc.sc()
    return max(1, inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile()))


class Peers:
    """The tasks of a barrier stage. The first one combines an array of each, in the order of their ranks, and sends all the result."""

    def __enter__(self) -> Peers:
        from pyspark import BarrierTaskContext

        task = BarrierTaskContext.get()
        hosts = [x.address.rpartition(":")[0] or x.address for x in task.getTaskInfos()]
        self.rank, self.links = task.partitionId(), []
        if self.rank:
            host, port, key = task.allGather("")[0].split()
            link = socket.create_connection((host, int(port)), timeout=PATIENCE)
            self.links.append(self._quick(link))
            link.sendall(bytes.fromhex(key) + self.rank.to_bytes(4, "little"))
            return self
        key = secrets.token_bytes(16)
        with socket.create_server(("", 0), backlog=len(hosts)) as server:
            server.settimeout(PATIENCE)
            task.allGather(f"{hosts[0]} {server.getsockname()[1]} {key.hex()}")
            found: dict[int, socket.socket] = {}
            while len(found) < len(hosts) - 1:
                link = self._quick(server.accept()[0])
                hello = self._read(link, 20)
                if secrets.compare_digest(bytes(hello[:16]), key):
                    found[int.from_bytes(hello[16:], "little")] = link
        self.links = [found[k] for k in sorted(found)]
        return self

    def __exit__(self, *_) -> None:
        for link in self.links:
            link.close()

    @staticmethod
    def _quick(link: socket.socket) -> socket.socket:
        link.settimeout(PATIENCE)
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return link

    @staticmethod
    def _read(link: socket.socket, n: int) -> bytearray:
        out = bytearray(n)
        view = memoryview(out)
        while n:
            got = link.recv_into(view[len(out) - n :], n)
            if not got:
                raise ConnectionError("another task of the stage ended")
            n -= got
        return out

    def _get(self, link: socket.socket, like: np.ndarray) -> np.ndarray:
        return np.frombuffer(self._read(link, int.from_bytes(self._read(link, 8), "little")), like.dtype)

    @staticmethod
    def _send(link: socket.socket, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x)
        link.sendall(x.nbytes.to_bytes(8, "little"))
        link.sendall(x.data.cast("B") if x.nbytes else b"")

    def combine(self, x: np.ndarray, how: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """``how`` over the one-dimensional arrays of all tasks; each must call it as often."""
        if self.rank:
            self._send(self.links[0], x)
            return self._get(self.links[0], x)
        for link in self.links:
            x = how(x, self._get(link, x))
        for link in self.links:
            self._send(link, x)
        return x
