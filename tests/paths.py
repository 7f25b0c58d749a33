"""Places of the test tables and fixtures."""

import os

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
CREDIT_CSV = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data", "credit_scored.csv")
