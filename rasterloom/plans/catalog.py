"""All registered queries of the library's own operators, and their SQL."""

from . import archives, measures, media, more, movies, paint, pictures, planes, search, state

_MODULES = (state, paint, search, media, more, planes, measures, movies, archives, pictures)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
