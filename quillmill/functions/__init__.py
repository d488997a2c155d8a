"""Column functions: no DataFrame, no session, no Python at run time."""
