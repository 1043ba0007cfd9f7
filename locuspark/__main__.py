import sys

from locuspark.cli import main

sys.exit(main())
