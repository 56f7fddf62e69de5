"""``python -m arcframe``."""

import sys

from .cli import main

sys.exit(main())
