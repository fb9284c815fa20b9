"""Scalar functions: every one takes Columns and returns a Column."""

from .commands import *      # noqa: F401,F403
from .paths import *         # noqa: F401,F403
from .status import *        # noqa: F401,F403
from .values import *        # noqa: F401,F403
