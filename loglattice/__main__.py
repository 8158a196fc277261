import sys

from loglattice.cli import main

sys.exit(main())
