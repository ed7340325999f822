"""Logging is off unless NEARFIELD_LOG names a level, such as info."""

import logging
import os


def setup() -> None:
    """Called when the package is imported; call it again after the variable has changed."""
    level = os.environ.get("NEARFIELD_LOG", "off").upper()
    known = logging.getLevelNamesMapping()
    logging.getLogger("nearfield").setLevel(known.get(level, logging.CRITICAL + 1))
