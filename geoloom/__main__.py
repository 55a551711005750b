"""``python -m geoloom``."""

import sys

from geoloom.cli import main

sys.exit(main())
