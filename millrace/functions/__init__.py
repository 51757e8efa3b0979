"""Scalar functions and operators of the dialect as functions from columns to columns."""

from millrace.functions.dates import *  # noqa: F403
from millrace.functions.maths import *  # noqa: F403
from millrace.functions.misc import *  # noqa: F403
from millrace.functions.operators import *  # noqa: F403
from millrace.functions.strings import *  # noqa: F403
