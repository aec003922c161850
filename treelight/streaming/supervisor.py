"""Keeps change ingestion going: which failures end it, which rebuild the volume, which are tried again."""

from __future__ import annotations

import time
from collections.abc import Callable

RETRY_SECONDS = 2.0
MOST_RETRIES = 10


class JournalGone(Exception):
    """The saved position is no longer in the journal, or the journal is another one."""


def supervise(run: Callable[[bool], None], sleep: Callable[[float], None] = time.sleep) -> None:
    """Calls run(rebuild) until it returns. Missing rights end it at once; a journal that's gone rebuilds, after a pause;
    anything else is tried again MOST_RETRIES times in a row."""
    rebuild, failures = False, 0
    while True:
        try:
            return run(rebuild)
        except PermissionError:
            raise
        except JournalGone:
            rebuild, failures = True, 0
        except Exception:
            failures += 1
            if failures > MOST_RETRIES:
                raise
        sleep(RETRY_SECONDS)
