"""Command line: python -m pathlark (grep | peers | legacy) ARGUMENTS."""

import sys

from .cli import main

sys.exit(main(sys.argv[1:]))
