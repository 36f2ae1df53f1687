"""Jobs that write: loading one provider file and refreshing the derived tables."""
