"""All queries of the library; importing the modules enters them."""

from bytespan.operators import archive, codelength, coder, contexts, formats, markup, profile, tables, transforms, vectors, vocabulary  # noqa: F401
from bytespan.plans import planner  # noqa: F401
from bytespan.registry import ORACLES, QUERIES  # noqa: F401
from bytespan.sources import files  # noqa: F401
from bytespan.streaming import profiles  # noqa: F401
