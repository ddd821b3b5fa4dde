"""Tables behind the charts; drawing them is left to the caller."""
