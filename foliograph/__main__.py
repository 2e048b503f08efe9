import sys

from foliograph.plans.command import run

if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
