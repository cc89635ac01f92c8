"""Session settings, staged tables and the registry of named views."""
