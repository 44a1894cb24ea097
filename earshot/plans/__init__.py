"""Named jobs: compositions of the operators."""
