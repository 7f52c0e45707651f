"""What a process remembers. Functions travel to the workers by value, and what their modules hold would travel with every task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any


def remembered(name: str, most: int, key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gave for this key, if it is among the last `most` of that name, else what it gives now."""
    own = sys.modules.setdefault("rasterloom_kept", types.ModuleType("rasterloom_kept")).__dict__.setdefault(name, {})
    if key not in own:
        made = make()
        if len(own) >= most:
            del own[next(iter(own))]
        own[key] = made
    return own[key]
