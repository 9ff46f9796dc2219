"""Training-data operators (see the repository README, section "Training-data operators").

Nothing outside this subpackage imports it; deleting it leaves the rest of the library working.
"""
