"""``python -m anchorage``: diagnostics of single files."""

import sys

from anchorage.plans.diagnostics import main

sys.exit(main())
