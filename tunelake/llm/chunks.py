"""Distinct-chunk tables: each distinct piece of text is encoded once, codes are joined back."""


class ChunkTable(dict):
    """The code of every chunk that a worker has met of late, `limit` chunks at most by and by.

    Chunks lie in two generations of half the limit: one that is met again moves to the
    younger one, and when that is full the older one goes, so frequent chunks stay. `encode`
    maps a list of distinct chunks to a list of their codes.
    """

    #: Characters of a generation's chunks for each chunk that it may hold.
    SIZE = 24

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.older: dict = {}
        self.size = 0

    def learn(self, chunks) -> None:
        """Encode the chunks that are not in the table. Until the next call all chunks are in it."""
        if 2 * len(self) > self.limit or 2 * self.size > self.SIZE * self.limit:
            self.older = dict(self)
            self.clear()
            self.size = 0
        missing = {c for c in chunks if c not in self}
        if not missing:
            return
        self.size += sum(map(len, missing))
        known = missing & self.older.keys()
        self.update(zip(known, map(self.older.__getitem__, known), strict=True))
        fresh = list(missing - known)
        if fresh:
            self.update(zip(fresh, self.encode(fresh), strict=True))
