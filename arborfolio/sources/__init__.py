"""Reading panels and memberships, and writing results."""
