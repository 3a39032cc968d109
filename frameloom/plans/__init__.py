"""Session plans: configuration, fixture views and registered queries."""
