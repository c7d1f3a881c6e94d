"""Column functions (JVM-side built-ins only): text cleaning, predicates,
dates and weeks, content keys."""

from .text import *  # noqa: F401,F403
from .time import *  # noqa: F401,F403
