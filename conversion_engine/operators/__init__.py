"""Relational operators: identity, attribution, bookings, cohort, milestones, funnels, features."""
