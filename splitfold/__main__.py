import sys

from splitfold.cli import main

sys.exit(main())
