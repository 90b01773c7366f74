"""Tasks of one barrier stage that exchange arrays among themselves, in a ring."""

from __future__ import annotations

import secrets
import socket
from concurrent.futures import ThreadPoolExecutor

import numpy as np

#: Seconds after which a task whose neighbour is silent gives up.
PATIENCE = 1800


class Gang:
    """The tasks of this barrier stage, each with ``count`` rows of its own.

    A task sends to the next one and hears from the one before; addresses and the word by which a neighbour is known
    go through Spark. What is exchanged is summed or put in order of tasks, so all tasks have the same numbers.
    """

    def __init__(self, count: int):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        infos = context.getTaskInfos()
        self.rank, self.size = context.partitionId(), len(infos)
        host, word = infos[self.rank].address.rpartition(":")[0], secrets.token_hex(16)
        with socket.create_server(("", 0)) as server:
            server.settimeout(PATIENCE)
            told = [x.split() for x in context.allGather(f"{host} {server.getsockname()[1]} {word} {count}")]
            counts = np.array([int(x[3]) for x in told])
            self.ends = np.concatenate([[0], np.cumsum(counts)])
            self.own = slice(int(self.ends[self.rank]), int(self.ends[self.rank + 1]))
            to, port, key, _ = told[(self.rank + 1) % self.size]
            self.right = socket.create_connection((to, int(port)), PATIENCE)
            self.right.sendall(key.encode())
            while True:
                self.left, _ = server.accept()
                self.left.settimeout(PATIENCE)
                if self._hear(len(word)) == word.encode():
                    break
                self.left.close()
        for end in (self.left, self.right):
            end.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.sender = ThreadPoolExecutor(1)

    def _hear(self, size: int) -> bytearray:
        out = bytearray(size)
        view = memoryview(out)
        while view:
            got = self.left.recv_into(view)
            if not got:
                raise ConnectionError("the task before this one in the ring has gone")
            view = view[got:]
        return out

    def _pass(self, x: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Send ``x`` on while an array of the shape of ``like`` comes in."""
        sent = self.sender.submit(self.right.sendall, np.ascontiguousarray(x).tobytes())
        got = np.frombuffer(self._hear(like.nbytes), like.dtype).reshape(like.shape)
        sent.result()
        return got

    def _around(self, parts: list[np.ndarray]) -> None:
        """Fill ``parts``, of which each task has its own, with those of all others."""
        for step in range(self.size - 1):
            parts[(self.rank - step - 1) % self.size][:] = self._pass(parts[(self.rank - step) % self.size], parts[(self.rank - step - 1) % self.size])

    def gather(self, x: np.ndarray) -> np.ndarray:
        """The rows of all tasks, in their order."""
        out = np.empty((int(self.ends[-1]), *x.shape[1:]), x.dtype)
        out[self.own] = x
        self._around([out[a:b] for a, b in zip(self.ends[:-1], self.ends[1:])])
        return out

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum over tasks: each sums one part of the array, then all hear all sums."""
        flat = x.reshape(-1).copy()
        parts = np.array_split(flat, self.size)
        for step in range(self.size - 1):
            parts[(self.rank - step - 2) % self.size] += self._pass(parts[(self.rank - step - 1) % self.size], parts[(self.rank - step - 2) % self.size])
        self._around(parts)
        return flat.reshape(x.shape)

    def slowest(self, seconds: float) -> float:
        mine = np.zeros(self.size)
        mine[self.rank] = seconds
        return float(self.total(mine).max())

    def close(self) -> None:
        self.sender.shutdown()
        self.left.close()
        self.right.close()
