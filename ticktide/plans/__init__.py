"""ticktide.plans"""
