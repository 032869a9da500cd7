"""Named queries over the test tables and their SQL twins."""

from lodestar.plans import storage, vectors

QUERIES: dict = {**vectors.QUERIES, **storage.QUERIES}
ORACLES: dict = {**vectors.ORACLES, **storage.ORACLES}
